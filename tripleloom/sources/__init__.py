"""Reading and writing tables, Turtle corpora, scheme registries, graphs and catalogs."""

from .catalog import catalog_snapshot, list_namespace, registered_tables
from .graphs import publish_graphs, read_graphs
from .schemes import parse_schemes, read_schemes, scheme_by_id, scheme_templates
from .tables import conform, read_back_report, read_table, write_table
from .turtle import read_corpus, read_corpus_lines

__all__ = [
    "catalog_snapshot",
    "conform",
    "list_namespace",
    "parse_schemes",
    "publish_graphs",
    "read_back_report",
    "read_corpus",
    "read_corpus_lines",
    "read_graphs",
    "read_schemes",
    "read_table",
    "registered_tables",
    "scheme_by_id",
    "scheme_templates",
    "write_table",
]
