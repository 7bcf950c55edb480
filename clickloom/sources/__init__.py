"""Input tables, external sources and sinks."""
