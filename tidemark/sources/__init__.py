from tidemark.sources.dims import dim_table, dictionary
from tidemark.sources.jdbc import read_jdbc_snapshot
from tidemark.sources.topics import (
    read_cdc_log, read_json_topic, read_order_detail, read_page_log, read_topic, read_topic_files,
)

__all__ = [
    "dictionary", "dim_table", "read_cdc_log", "read_jdbc_snapshot", "read_json_topic",
    "read_order_detail", "read_page_log", "read_topic", "read_topic_files",
]
