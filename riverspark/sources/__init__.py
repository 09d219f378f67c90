from riverspark.sources.tables import (
    append,
    daily_values,
    read_csv_skip,
    read_many,
    read_table,
    stack_tables,
    write_bucketed,
    write_table,
)

__all__ = [
    "append",
    "daily_values",
    "read_csv_skip",
    "read_many",
    "read_table",
    "stack_tables",
    "write_bucketed",
    "write_table",
]
