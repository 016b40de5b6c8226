"""Column functions. All run inside the JVM; none needs a Python UDF."""

from .iris import expand_curie, expand_known_prefix, iri_label, iri_local_part, iri_safe, iri_suffixes, iri_template
from .literals import (
    catalog_type,
    column_annotation,
    lexical_by_datatype,
    lexical_form,
    may_lack_form,
    type_json,
    xsd_datatype,
)
from .names import (
    bucket_of,
    contains_ignoring_case,
    preview_id,
    record_id,
    safe_name,
    source_uri,
    storage_location,
)
from .text import escape_literal, first_nonempty, strip, unix_lines

__all__ = [
    "bucket_of",
    "catalog_type",
    "column_annotation",
    "contains_ignoring_case",
    "escape_literal",
    "expand_curie",
    "expand_known_prefix",
    "first_nonempty",
    "iri_label",
    "iri_local_part",
    "iri_safe",
    "iri_suffixes",
    "iri_template",
    "lexical_by_datatype",
    "lexical_form",
    "may_lack_form",
    "preview_id",
    "record_id",
    "safe_name",
    "source_uri",
    "storage_location",
    "strip",
    "type_json",
    "unix_lines",
    "xsd_datatype",
]
