from tidemark.functions.jsons import parse_json, parsed, set_field, to_json_rows
from tidemark.functions.keys import spread
from tidemark.functions.maps import prune_columns, put_keys
from tidemark.functions.naming import camel_case, snake_case
from tidemark.functions.numbers import cast_delta, coalesce0, money
from tidemark.functions.times import (
    date_part, day_of, days_between, epoch_ms, from_epoch, to_date_text, to_datetime_text, to_ts,
)

__all__ = [
    "camel_case", "cast_delta", "coalesce0", "date_part", "day_of", "days_between", "epoch_ms",
    "from_epoch", "money", "parse_json", "parsed", "prune_columns", "put_keys",
    "set_field", "snake_case", "spread", "to_date_text", "to_datetime_text",
    "to_json_rows", "to_ts",
]
