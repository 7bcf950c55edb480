import pytest

from clickloom.params import Settings, TaskNotFound, TaskParams, first_value


def test_only_the_first_element_of_arrays_counts():
    t = TaskParams.from_json('{"startDate": ["2024-01-01", "2025-01-01"], "cities": ["a,b"], "categoryIds": ["1,12"], "targetPageFlow": ["1,2,3"]}')
    assert (t.start_date, t.cities, t.category_ids, t.target_page_flow) == ("2024-01-01", ("a", "b"), (1, 12), (1, 2, 3))


def test_absent_and_empty_mean_no_filter():
    t = TaskParams.from_json('{"sex": [""], "cities": [], "keywords": [null], "startAge": "7"}')
    assert (t.sex, t.cities, t.keywords, t.start_age) == (None, (), (), None)
    assert first_value({"a": ["x=1"]}, "a") == "x=1"


def test_a_missing_task_is_an_error(spark):
    tasks = spark.createDataFrame([(1, '{"sex": ["male"]}'), (2, None)], "task_id long, task_param string")
    assert TaskParams.from_table(tasks, 1).sex == "male"
    for missing in (2, 3):
        with pytest.raises(TaskNotFound):
            TaskParams.from_table(tasks, missing)


def test_settings_read_bad_numbers_as_zero():
    s = Settings.from_mapping({"blacklist_threshold": "7", "seed": "x", "unknown": 1, "batch_interval": "1 second"})
    assert (s.blacklist_threshold, s.seed, s.batch_interval) == (7, 0, "1 second")
