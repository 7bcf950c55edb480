"""Task parameters.

A task row carries a JSON object whose fields are arrays; only element 0 of each counts, and lists are comma-joined inside it. An
absent or empty value means that nothing is filtered.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class TaskNotFound(LookupError):
    """No task has the id asked for."""


def first_value(document: dict, name: str) -> str | None:
    """Element 0 of the array at a field, as text; None if it is absent or empty."""
    values = document.get(name)
    if not isinstance(values, list) or not values or values[0] is None:
        return None
    return str(values[0]).strip() or None


def _items(value: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.split(",") if x.strip()) if value else ()


@dataclass(frozen=True)
class TaskParams:
    """What a task asks for; None and empty tuples mean no restriction."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    sex: str | None = None
    keywords: tuple[str, ...] = ()
    category_ids: tuple[int, ...] = ()
    target_page_flow: tuple[int, ...] = ()
    task_id: int = field(default=0)

    @classmethod
    def from_json(cls, text: str, task_id: int = 0) -> TaskParams:
        document = json.loads(text)

        def number(name: str) -> int | None:
            value = first_value(document, name)
            return int(value) if value is not None else None

        return cls(
            start_date=first_value(document, "startDate"),
            end_date=first_value(document, "endDate"),
            start_age=number("startAge"),
            end_age=number("endAge"),
            professionals=_items(first_value(document, "professionals")),
            cities=_items(first_value(document, "cities")),
            sex=first_value(document, "sex"),
            keywords=_items(first_value(document, "keywords")),
            category_ids=tuple(int(x) for x in _items(first_value(document, "categoryIds"))),
            target_page_flow=tuple(int(x) for x in _items(first_value(document, "targetPageFlow"))),
            task_id=task_id,
        )

    @classmethod
    def from_table(cls, tasks, task_id: int) -> TaskParams:
        """From a task table with task_id and task_param; a missing task is an error, not a late failure."""
        rows = tasks.where(tasks.task_id == task_id).select("task_param").limit(1).collect()
        if not rows or rows[0].task_param is None:
            raise TaskNotFound(f"no task {task_id}")
        return cls.from_json(rows[0].task_param, task_id)


@dataclass(frozen=True)
class Settings:
    """Configuration with the defaults of the jobs."""

    blacklist_threshold: int = 100
    sample_sessions: int = 100
    top_categories: int = 10
    top_sessions: int = 10
    top_products: int = 3
    top_ads: int = 3
    batch_interval: str = "5 seconds"
    trend_window: str = "60 minutes"
    trend_slide: str = "10 seconds"
    seed: int = 9

    @classmethod
    def from_mapping(cls, values: dict) -> Settings:
        """Known names only; a number that cannot be read becomes 0."""

        def read(kind, value):
            if kind is int:
                try:
                    return int(value)
                except (TypeError, ValueError):
                    return 0
            return str(value)

        kinds = {"batch_interval": str, "trend_window": str, "trend_slide": str}
        return cls(**{k: read(kinds.get(k, int), v) for k, v in values.items() if k in cls.__dataclass_fields__})
