"""Mappings over streams."""

from .materialize import distinct_stream, materialize_stream, read_table_stream, run_available
from .sink import GraphSink, run_into_graph

__all__ = ["GraphSink", "distinct_stream", "materialize_stream", "read_table_stream", "run_available", "run_into_graph"]
