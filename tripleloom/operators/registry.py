"""Mapping records as a log of events and the states that follow from it.

Which event of a kind is the newest is one aggregation by mapping id over times
and numbers, which combines on the map side, so a mapping with a third of all
events costs no more than any other. Texts are fetched for the winners only. A
state can be stored and advanced by newer events, so that a long log is not
read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT_SCHEMA
from .render import payload_text, render_keyed, spec_key
from .validate import validation_summary

REGISTER, UPDATE, ACTIVATE, DEPRECATE, DELETE = "register", "update", "activate", "deprecate", "delete"
STATUS_AFTER = {ACTIVATE: "active", DEPRECATE: "deprecated"}

RECORD_COLUMNS = ("id", "source", "ontology", "profile", "status", "created_at", "updated_at", "payload", "rml")


def _events(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(field.name).cast(field.dataType) for field in EVENT_SCHEMA.fields])


def derived_id(*parts: Column) -> Column:
    """A record id that comes out the same when a task runs again: 128 bits of a hash, so that batches of any size keep apart."""
    return F.concat(F.lit("map-"), F.substr(F.sha2(F.concat_ws("\u0000", *parts), 256), F.lit(1), F.lit(32)))


def register_batch(
    specs: DataFrame,
    schemes: DataFrame,
    at: Column,
    seq: Column | None = None,
    new_id: Column | None = None,
    batch: str = "",
) -> DataFrame:
    """Register events of all sound declarations, with their rendered documents.

    ``new_id`` and ``seq`` are expressions over the declaration rows. By default
    the id follows from the batch name and the declaration.
    """
    payload = payload_text()
    chosen = derived_id(F.lit(batch), F.col("mapping_id"), payload) if new_id is None else new_id
    numbered = specs.select(
        "mapping_id",
        spec_key().alias("spec_key"),
        chosen.alias("record_id"),
        (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"),
        "ontology",
        "profile",
        payload.alias("payload"),
    )
    rendered = render_keyed(specs, schemes).where(F.col("rml").isNotNull())
    return _events(
        numbered.join(rendered, ["mapping_id", "spec_key"]).select(
            F.col("record_id").alias("mapping_id"),
            "seq",
            at.alias("ts"),
            F.lit(REGISTER).alias("op"),
            F.lit("simple").alias("source"),
            "ontology",
            "profile",
            F.lit("draft").alias("status"),
            "payload",
            "rml",
        )
    )


def _when(*ops: str) -> Column:
    return F.when(F.col("op").isin(*ops), F.struct("ts", "seq"))


def _winners(events: DataFrame) -> DataFrame:
    """Per mapping, which events count: when it was born, died, got its text, its status, and was last touched.

    Only times, numbers and states are aggregated; the texts stay in their rows until the winners are known.
    """
    status = (
        F.when(F.col("op") == ACTIVATE, STATUS_AFTER[ACTIVATE]).when(F.col("op") == DEPRECATE, STATUS_AFTER[DEPRECATE]).otherwise(F.col("status"))
    )
    decided = F.when(F.col("op").isin(REGISTER, ACTIVATE, DEPRECATE), F.struct("ts", "seq", status.alias("status")))
    return events.groupBy("mapping_id").agg(
        F.max(_when(REGISTER)).alias("born"),
        F.max(_when(DELETE)).alias("died"),
        F.max(_when(REGISTER, UPDATE)).alias("texted"),
        F.max(decided).alias("decided"),
        F.max(_when(REGISTER, UPDATE, ACTIVATE, DEPRECATE)).alias("touched"),
    )


_MOMENTS = ("born", "died", "texted", "decided", "touched")


def _state(events: DataFrame) -> DataFrame:
    """The winners with what their rows say: ``birth`` and ``text``."""
    winners = _winners(events)
    at = F.struct("ts", "seq").alias("at")
    rows = events.where(F.col("op").isin(REGISTER, UPDATE)).select("mapping_id", at, "op", "source", "ontology", "profile", "payload", "rml")
    wanted = winners.select("mapping_id", F.explode(F.array_distinct(F.array("born", "texted"))).alias("at")).where("at is not null")
    # At most two rows a mapping have their texts moved.
    found = rows.join(wanted, ["mapping_id", "at"], "left_semi")
    births = found.where(F.col("op") == REGISTER).dropDuplicates(["mapping_id", "at"])
    births = births.select("mapping_id", F.col("at").alias("born"), F.struct("ontology", "profile", "payload").alias("birth"))
    source = F.when(F.col("op") == UPDATE, F.lit("rml")).otherwise(F.col("source")).alias("source")
    texts = found.dropDuplicates(["mapping_id", "at"]).select("mapping_id", F.col("at").alias("texted"), F.struct(source, "rml").alias("text"))
    return winners.join(births, ["mapping_id", "born"], "left").join(texts, ["mapping_id", "texted"], "left").select("mapping_id", *_MOMENTS, "birth", "text")


def advance(state: DataFrame | None, events: DataFrame) -> DataFrame:
    """The state of all mappings after more events; without a state, from the whole log.

    A state is what the log comes down to: one row a mapping, the dead included, from which :func:`records_of` reads the
    records. Events may come in any order, and some may come again: the newest of each kind counts. Mappings that
    ``events`` does not name pass unchanged, without a shuffle if few are named.
    """
    newer = _state(events)
    if state is None:
        return newer
    same = state.join(newer.select("mapping_id"), "mapping_id", "left_anti")
    older = state.select("mapping_id", F.struct(*_MOMENTS, "birth", "text").alias("old"))
    met = newer.join(older, "mapping_id", "left")
    later = lambda moment: F.greatest(F.col(moment), F.col(f"old.{moment}"))
    kept = lambda part, moment: F.when(
        F.col(f"old.{moment}").isNotNull() & (F.col(moment).isNull() | (F.col(f"old.{moment}") > F.col(moment))), F.col(f"old.{part}")
    ).otherwise(F.col(part))
    moved = met.select("mapping_id", *[later(m).alias(m) for m in _MOMENTS], kept("birth", "born").alias("birth"), kept("text", "texted").alias("text"))
    return same.unionByName(moved)


def _alive() -> Column:
    return F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("died") < F.col("born")))


def records_of(state: DataFrame) -> DataFrame:
    """The records of a state."""
    return state.where(_alive()).select(
        F.col("mapping_id").alias("id"),
        F.col("text.source").alias("source"),
        F.col("birth.ontology").alias("ontology"),
        F.col("birth.profile").alias("profile"),
        F.col("decided.status").alias("status"),
        F.col("born.ts").alias("created_at"),
        F.col("touched.ts").alias("updated_at"),
        F.col("birth.payload").alias("payload"),
        F.col("text.rml").alias("rml"),
    )


def current_records(events: DataFrame) -> DataFrame:
    """The record of every mapping that is registered and not deleted since."""
    return records_of(advance(None, events))


def current_status(events: DataFrame) -> DataFrame:
    """``(id, status, updated_at)`` of every living mapping; reads no document text."""
    living = _winners(events).where(_alive())
    return living.select(F.col("mapping_id").alias("id"), F.col("decided.status").alias("status"), F.col("touched.ts").alias("updated_at"))


def list_mappings(records: DataFrame) -> DataFrame:
    return records.orderBy("id")


def mappings_by_dataset(records: DataFrame, dataset: str) -> DataFrame:
    """Records whose declaration names the dataset; expert documents have none to name it."""
    return records.where(F.get_json_object("payload", "$.dataset.name") == dataset)


def active_mappings(records: DataFrame) -> DataFrame:
    return records.where(F.col("status") == "active")


def documents_of(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("mapping_id"), "rml")


def rml_for_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the records named in ``ids(id)``."""
    return documents_of(records.join(ids.select("id").distinct(), "id", "left_semi"))


def mapping_responses(records: DataFrame, corpus: DataFrame, classes: DataFrame) -> DataFrame:
    """Records together with the validation summary of their documents."""
    summary = validation_summary(corpus, classes).withColumnRenamed("mapping_id", "id")
    return records.join(summary, "id", "left").select(
        *RECORD_COLUMNS,
        F.coalesce("valid", F.lit(True)).alias("valid"),
        F.coalesce("projection_count", F.lit(0)).alias("projection_count"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def projection_jobs(ids: DataFrame, job_id: Column, at: Column, target: str) -> DataFrame:
    """Log rows of a projection run, one per mapping it covered.

    A job over all mappings names as many ids as there are mappings, which is
    why they are rows here and not one array.
    """
    return ids.select(
        job_id.alias("job_id"),
        F.lit("succeeded").alias("status"),
        at.alias("created_at"),
        F.col("id").alias("mapping_id"),
        F.lit(target).alias("target"),
    )


def job_overview(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_id", "status", "target").agg(
        F.min("created_at").alias("created_at"), F.count("mapping_id").alias("mapping_count")
    )


#: Size of a distinct-count sketch (two to this power of buckets), and the relative error that estimates stay below
#: in all but about one of a thousand cases.
SKETCH_SIZE, SKETCH_ERROR = 14, 0.03


def profile_sketches(df: DataFrame, part: Column) -> DataFrame:
    """``(part, column_name, type_name, row_count, null_count, sketch)`` per part and column of a table.

    Sketches of parts add up: a table's profile is :func:`merge_profiles` over those stored of its parts, so new data is
    read once and old data never again. A part's rows meet as sketches, combined on the map side, however many they are.
    """
    fields = df.schema.fields
    cells = [cell for i, f in enumerate(fields) for cell in (F.lit(i), _profiled(f))]
    values = df.select(part.alias("part"), F.stack(F.lit(len(fields)), *cells).alias("at", "value"))
    names = F.array(*[F.lit(f.name) for f in fields])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    return (
        values.groupBy("part", "at")
        .agg(
            F.count("*").alias("row_count"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.hll_sketch_agg("value", SKETCH_SIZE).alias("sketch"),
        )
        .select(
            "part",
            F.element_at(names, F.col("at") + 1).alias("column_name"),
            F.element_at(types, F.col("at") + 1).alias("type_name"),
            "row_count",
            "null_count",
            "sketch",
        )
    )


def merge_profiles(sketches: DataFrame, *by: str) -> DataFrame:
    """The profile of all parts together, or of those alike in ``by``; distinct counts are estimates (``SKETCH_ERROR``).

    Columns are told apart by name and type, so parts written before and after a change of schema can be merged.
    """
    return sketches.groupBy(*by, "column_name", "type_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
    )


def _profiled(field: T.StructField) -> Column:
    """A column's value as the text by which a profile tells values apart."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    text = F.to_json(F.struct(column)) if "<" in field.dataType.simpleString() else column.cast("string")
    return F.when(column.isNotNull(), text)


def dataset_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(column_name, type_name, row_count, null_count, distinct_count)`` per column.

    Exact counts group values before counting them, in one read of the table;
    ``exact=False`` takes sketches instead and shuffles next to nothing.
    """
    fields = df.schema.fields
    if not exact:
        sketches = df.agg(
            F.count("*").alias("_rows"),
            *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_nulls_{i}") for i, f in enumerate(fields)],
            *[F.approx_count_distinct(f"`{f.name}`").alias(f"_values_{i}") for i, f in enumerate(fields)],
        )
        cells = []
        for i, f in enumerate(fields):
            cells += [
                F.lit(f.name),
                F.lit(f.dataType.simpleString()),
                F.col("_rows"),
                F.col(f"_nulls_{i}"),
                F.col(f"_values_{i}"),
            ]
        return sketches.select(
            F.stack(F.lit(len(fields)), *cells).alias(
                "column_name", "type_name", "row_count", "null_count", "distinct_count"
            )
        )
    cells = [cell for i, f in enumerate(fields) for cell in (F.lit(i), _profiled(f))]
    values = df.select(F.stack(F.lit(len(fields)), *cells).alias("at", "value"))
    per_value = values.groupBy("at", "value").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(f.name) for f in fields])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    return (
        per_value.groupBy("at")
        .agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
        .select(
            F.element_at(names, F.col("at") + 1).alias("column_name"),
            F.element_at(types, F.col("at") + 1).alias("type_name"),
            "row_count",
            "null_count",
            "distinct_count",
        )
    )


