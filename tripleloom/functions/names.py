"""Names, identifiers and storage addresses of datasets and mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import BUCKET_PATTERN
from .text import first_nonempty


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "-")


def preview_id(dataset_name: Column) -> Column:
    """Readable mapping id made from a dataset name."""
    name = F.coalesce(first_nonempty(dataset_name), F.lit("dataset"))
    return F.concat(F.lit("mapping-"), F.replace(name, F.lit("."), F.lit("-")))


def record_id(reference: Column) -> Column:
    """Mapping id out of a reference that is a bare id or a JSON record with an ``id``.

    Null stands for a record without one; the caller decides whether that is an error.
    """
    is_record = F.ltrim(reference).startswith("{")
    return F.when(is_record, first_nonempty(F.get_json_object(reference, "$.id"))).otherwise(reference)


def storage_location(name: Column, declared: Column) -> Column:
    """Declared location, by default the dataset name as an ``s3://`` path."""
    default = F.concat(F.lit("s3://"), F.replace(name, F.lit("."), F.lit("/")))
    return F.coalesce(first_nonempty(declared), default)


def source_uri(location: Column, declared: Column) -> Column:
    """Declared source, by default the location with its first ``s3://`` made ``s3a://``."""
    at = F.instr(location, "s3://")
    default = F.when(at > 0, F.overlay(location, F.lit("s3a://"), at, F.lit(5))).otherwise(location)
    return F.coalesce(first_nonempty(declared), default)


def bucket_of(uri: Column) -> Column:
    """Bucket of an ``s3a`` address; null if the scheme is another or the bucket is empty."""
    return F.nullif(F.regexp_extract(uri, BUCKET_PATTERN, 1), F.lit(""))


def contains_ignoring_case(text: Column, wanted: Column) -> Column:
    return F.contains(F.lower(text), F.lower(wanted))
