from tidemark.streaming.counts import RecordCounts
from tidemark.streaming.events import with_event_time
from tidemark.streaming.run import run_stream
from tidemark.streaming.state import (
    daily_first_flag_stream, day_firsts_stream, login_firsts_stream, order_firsts_stream,
    repair_is_new_stream, repair_log_stream,
)

__all__ = [
    "RecordCounts",
    "daily_first_flag_stream", "day_firsts_stream", "login_firsts_stream", "order_firsts_stream",
    "repair_is_new_stream", "repair_log_stream", "run_stream", "with_event_time",
]
