from tidemark.sinks.ddl import apply_table_ddl
from tidemark.sinks.summary import write_summary
from tidemark.sinks.tables import FirstsTable, KeyedTable
from tidemark.sinks.topics import (
    append_batch, debug_stream, topic_rows, write_json_topic, write_topic, write_topic_files,
)

__all__ = [
    "FirstsTable", "KeyedTable", "append_batch", "apply_table_ddl", "debug_stream", "topic_rows",
    "write_json_topic", "write_summary", "write_topic", "write_topic_files",
]
