"""Table rows to triples.

Four plan shapes, chosen by what is asked for:

* ``rows``: one scan, one ``stack`` generator, for materialising everything;
* ``branches``: one projection per rule, united. Catalyst pushes a filter on
  ``p`` into it, drops the other branches and reads only their columns;
* merged: for many mappings of one table, their rules as data beside one scan;
* compact: for set semantics, de-duplicates short typed keys and values and
  builds the long strings after the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import iri_template, lexical_by_datatype, lexical_form, may_lack_form
from ..plans import MappingPlan, TripleRule, template_key
from ..session import spread
from ..vocab import TRIPLE_COLUMNS

# Values of these types never hold a character that an IRI would have to escape.
_PLAIN_TYPES = (T.IntegralType, T.BooleanType, T.DateType, T.DecimalType, T.DoubleType, T.FloatType)
# Keys of these types compare equal exactly when their texts do.
_COMPACT_TYPES = (T.IntegralType, T.BooleanType, T.DateType, T.StringType)
_INVERTIBLE_TYPES = (T.IntegralType, T.StringType)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class _Source:
    """A table seen through a mapping: text and IRI expressions of its columns."""

    def __init__(self, df: DataFrame, plan: MappingPlan, carry: tuple[str, ...] = ()):
        known = {field.name: field.dataType for field in df.schema.fields}
        missing = [name for name in plan.columns() if name not in known]
        if missing:
            raise ValueError(f"columns not in the source table: {', '.join(missing)}")
        self.types = known
        self.plan = plan
        key = _column(plan.subject_column)
        read = list(dict.fromkeys([*plan.columns(), *carry]))
        self.rows = df.select(*[_column(name) for name in read]).where(key.isNotNull())

    def text(self, name: str) -> Column:
        return lexical_form(_column(name), self.types[name])

    def iri(self, template: str, name: str) -> Column:
        return iri_template(template, self.text(name), encode=not isinstance(self.types[name], _PLAIN_TYPES))

    def subject(self) -> Column:
        return self.iri(self.plan.subject_template, self.plan.subject_column)

    def object(self, rule: TripleRule) -> Column:
        if rule.column is None:
            return F.lit(rule.constant)
        return self.literal(rule.column, rule.datatype) if rule.template is None else self.iri(rule.template, rule.column)

    def literal(self, name: str, datatype: str | None) -> Column:
        return lexical_by_datatype(_column(name), self.types[name], datatype)

    def keyed_by(self, template: str, column: str, iri: str) -> Column | None:
        """Condition on the source column that a row making ``iri`` must meet, where there is one."""
        if not isinstance(self.types[column], _INVERTIBLE_TYPES):
            return None
        key = template_key(template, iri)
        if key is None:
            return None
        return _column(column) == F.lit(key).try_cast(self.types[column])


def _text_lit(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _triples(df: DataFrame, graph: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({"graph": F.lit(graph), "o_lang": _text_lit(None)}).select(*TRIPLE_COLUMNS, *carry)


def _no_triples(df: DataFrame, graph: str) -> DataFrame:
    empty = df.limit(0).select(*[_text_lit(None).alias(name) for name in ("s", "p", "o", "o_type", "o_datatype")])
    return _triples(empty, graph)


def materialize(
    df: DataFrame,
    plan: MappingPlan,
    graph: str,
    shape: str = "rows",
    subject: str | None = None,
    predicate: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Triples of a table under a mapping, duplicates included.

    A bound ``predicate`` keeps only its rules. A bound ``subject`` becomes a
    condition on the key column, which the scan can use. Columns in ``carry`` go
    along with every triple of their row.
    """
    if predicate is not None:
        plan = plan.bound_to(predicate)
    if not plan.rules:
        return _no_triples(df, graph)
    source = _Source(df, plan, carry)
    rows = source.rows
    if subject is not None:
        key = source.keyed_by(plan.subject_template, plan.subject_column, subject)
        rows = rows if key is None else rows.where(key)
    if shape == "rows" and len(plan.rules) > 1:
        made = _stacked(rows, source, carry)
    elif shape in ("rows", "branches"):
        made = _branches(rows, source, carry)
    else:
        raise ValueError(f"unknown plan shape: {shape}")
    if subject is not None:
        # 07 and 7 are one number but two IRIs.
        made = made.where(F.col("s") == subject)
    return _triples(made, graph, carry)


def _stacked(rows: DataFrame, source: _Source, carry: tuple[str, ...]) -> DataFrame:
    rules = source.plan.rules
    cells: list[Column] = []
    for rule in rules:
        cells += [F.lit(rule.predicate), source.object(rule), F.lit(rule.o_type), _text_lit(rule.datatype)]
    stacked = F.stack(F.lit(len(rules)), *cells).alias("p", "o", "o_type", "o_datatype")
    return rows.select(*carry, source.subject().alias("s"), stacked).where(F.col("o").isNotNull())


def _branches(rows: DataFrame, source: _Source, carry: tuple[str, ...]) -> DataFrame:
    def branch(rule: TripleRule) -> DataFrame:
        present = rows if rule.column is None else rows.where(_column(rule.column).isNotNull())
        literal = rule.column is not None and rule.template is None
        made = present.select(
            *carry,
            source.subject().alias("s"),
            F.lit(rule.predicate).alias("p"),
            source.object(rule).alias("o"),
            F.lit(rule.o_type).alias("o_type"),
            _text_lit(rule.datatype).alias("o_datatype"),
        )
        return made.where(F.col("o").isNotNull()) if literal and may_lack_form(source.types[rule.column], rule.datatype) else made

    return reduce(DataFrame.unionByName, [branch(rule) for rule in source.plan.rules])


def materialize_distinct(df: DataFrame, plan: MappingPlan, graph: str) -> DataFrame:
    """Triples of a table under a mapping as a set.

    Equal to ``distinct`` over :func:`materialize`, but what goes through the
    shuffle is the key, a rule number and the bare value rather than IRIs. The
    shuffle key holds the value too, so a key that owns much of the table still
    spreads, and equal rows meet in the map-side aggregate first.
    """
    rules = list(dict.fromkeys(plan.rules))
    source = _Source(df, MappingPlan(plan.subject_column, plan.subject_template, tuple(rules)))
    # Rules that could state the same triple must be compared by their final objects.
    by_face: dict[tuple[str, str, str | None], list[TripleRule]] = {}
    for rule in rules:
        by_face.setdefault((rule.predicate, rule.o_type, rule.datatype), []).append(rule)
    faces = list(by_face)

    cells: list[Column] = []
    for rule in rules:
        face = (rule.predicate, rule.o_type, rule.datatype)
        if len(by_face[face]) > 1:
            value = source.object(rule)
        elif rule.column is None:
            value = F.lit("")
        elif rule.template is None:
            value = source.object(rule)
        else:
            value = source.text(rule.column)
        cells += [F.lit(faces.index(face)), value]
    key = _column(plan.subject_column)
    if not isinstance(source.types[plan.subject_column], _COMPACT_TYPES):
        key = source.text(plan.subject_column)
    kept = (
        source.rows.select(key.alias("k"), F.stack(F.lit(len(rules)), *cells).alias("face", "v"))
        .where(F.col("v").isNotNull())
        .distinct()
    )

    objects = F.lit(None).cast("string")
    for index, face in enumerate(faces):
        sharing = by_face[face]
        rule = sharing[0]
        if len(sharing) > 1 or rule.o_type == "literal":
            made = F.col("v")
        elif rule.column is None:
            made = F.lit(rule.constant)
        else:
            plain = isinstance(source.types[rule.column], _PLAIN_TYPES)
            made = iri_template(rule.template or "", F.col("v"), encode=not plain)
        objects = F.when(F.col("face") == index, made).otherwise(objects)

    def of_face(position: int) -> Column:
        return F.element_at(F.array(*[_text_lit(face[position]) for face in faces]), F.col("face") + 1)

    key_plain = isinstance(source.types[plan.subject_column], _PLAIN_TYPES)
    made = kept.select(
        iri_template(plan.subject_template, F.col("k").cast("string"), encode=not key_plain).alias("s"),
        of_face(0).alias("p"),
        objects.alias("o"),
        of_face(1).alias("o_type"),
        of_face(2).alias("o_datatype"),
    )
    return _triples(made, graph)


def materialize_all(parts: Iterable[tuple[DataFrame, MappingPlan, str]], shape: str = "rows") -> DataFrame:
    """Triples of several tables, each under its own mapping and in its own graph."""
    frames = [materialize(df, plan, graph, shape=shape) for df, plan, graph in parts]
    if not frames:
        raise ValueError("nothing to materialise")
    return reduce(DataFrame.unionByName, frames)


#: What a merged mapping says of a rule; ``at`` and ``key`` are places among the row's texts.
_MERGED = "graph string, key int, subject string, p string, at int, template string, o_type string, o_datatype string"

#: From this many rules on, a row makes so much more than it holds that rows are dealt anew before they meet them.
MANY_RULES = 64


def materialize_many(df: DataFrame, jobs: Sequence[tuple[MappingPlan, str]]) -> DataFrame:
    """Triples of one table under many mappings, each with its graph, in one scan.

    Equal to the union of :func:`materialize` over the jobs. The rules of all mappings are one constant list that every
    row meets; each column is turned into text, and encoded for IRIs, once a row, however many rules use it. So the
    plan has one expression a column, and a thousand mappings are no larger a program than one. From ``MANY_RULES`` rules
    on, rows are dealt anew first, as texts: what one task reads of a small file would make too much in it.
    """
    jobs = [(plan, graph) for plan, graph in jobs if plan.rules]
    if not jobs:
        return _no_triples(df, "")
    used = list(dict.fromkeys(name for plan, _ in jobs for name in plan.columns()))
    whole = _Source(df, MappingPlan(used[0], "", tuple(TripleRule("", "literal", column=name) for name in used)))
    # Forms of columns: in an IRI, or as a literal of a datatype.
    forms: dict[tuple[str, bool, str | None], int] = {}

    def place(name: str, in_iri: bool, datatype: str | None = None) -> int:
        return forms.setdefault((name, in_iri, datatype), len(forms))

    rules = [
        {
            "graph": graph,
            "key": place(plan.subject_column, True),
            "subject": plan.subject_template,
            "p": rule.predicate,
            "at": None if rule.column is None else place(rule.column, rule.template is not None, rule.datatype),
            "template": rule.constant if rule.column is None else rule.template,
            "o_type": rule.o_type,
            "o_datatype": rule.datatype,
        }
        for plan, graph in jobs
        for rule in plan.rules
    ]
    held = F.array(*[whole.iri("{value}", name) if in_iri else whole.literal(name, datatype) for name, in_iri, datatype in forms])
    rows = df.select(*[_column(name) for name in used]).select(held.alias("_texts"))
    if len(rules) >= MANY_RULES:
        rows = spread(rows)
    stated = rows.select("_texts", F.explode(F.from_json(F.lit(json.dumps(rules)), f"array<struct<{_MERGED}>>")).alias("_rule"))
    rule = {name: F.col(f"_rule.{name}") for name in ("graph", "key", "subject", "p", "at", "template", "o_type", "o_datatype")}
    key, value = F.get("_texts", rule["key"]), F.get("_texts", rule["at"])
    slot = F.lit("{value}")
    made = F.when(rule["at"].isNull(), rule["template"]).when(rule["template"].isNull(), value).otherwise(F.replace(rule["template"], slot, value))
    return (
        stated.select(
            rule["graph"],
            F.replace(rule["subject"], slot, key).alias("s"),
            rule["p"],
            made.alias("o"),
            rule["o_type"],
            rule["o_datatype"],
            _text_lit(None).alias("o_lang"),
        )
        .where(F.col("s").isNotNull() & F.col("o").isNotNull())
        .select(*TRIPLE_COLUMNS)
    )


def untyped_values(df: DataFrame, plan: MappingPlan) -> DataFrame:
    """``(column, datatype, rows)``: values that are no literal of their declared datatype, and so make no triple."""
    rules = list(dict.fromkeys((r.column, r.datatype) for r in plan.rules if r.column is not None and r.template is None))
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, datatype string, rows long")
    source = _Source(df, plan)
    failed = [F.count_if(_column(name).isNotNull() & source.literal(name, datatype).isNull()) for name, datatype in rules]
    cells = [cell for (name, datatype), count in zip(rules, failed) for cell in (F.lit(name), _text_lit(datatype), count)]
    return source.rows.agg(F.array(*[F.struct(*cells[i : i + 3]) for i in range(0, len(cells), 3)]).alias("all")).select(
        F.inline("all").alias("column", "datatype", "rows")
    ).where(F.col("rows") > 0)


def distinct_triples(triples: DataFrame) -> DataFrame:
    """A graph is a set: equal triples of one graph count once."""
    return triples.select(*TRIPLE_COLUMNS).distinct()


def dangling_references(references: DataFrame, subjects: DataFrame) -> DataFrame:
    """Linked IRIs that no triple of ``subjects`` describes, with how often each is linked.

    Both sides are reduced before the join: a popular target and a resource with
    many triples are one row each in it.
    """
    linked = (
        references.where(F.col("o_type") == "uri").groupBy("p", "o").agg(F.count("*").alias("reference_count"))
    )
    known = subjects.select(F.col("s").alias("known")).distinct()
    return linked.join(known, F.col("o") == F.col("known"), "left_anti")


def dangling_keys(df: DataFrame, plan: MappingPlan, predicate: str, subjects: DataFrame, subject_plan: MappingPlan, graph: str = "") -> DataFrame:
    """:func:`dangling_references` of one table's links to another table's subjects, on keys instead of IRIs.

    Where a link and the subject have one template, equal IRIs come from equal keys: the key columns are compared, as
    numbers if both are whole numbers, else as texts, and IRIs are made of what is left. Otherwise IRIs are compared.
    """
    rules = [rule for rule in plan.bound_to(predicate).rules if rule.o_type == "uri"]
    same = all(rule.column is not None and rule.template == subject_plan.subject_template for rule in rules)
    if not rules or not same or "{value}" not in subject_plan.subject_template:
        links = materialize(df, plan, graph, predicate=predicate)
        return dangling_references(links, materialize(subjects, subject_plan, graph).select("s"))
    links, known = _Source(df, plan.bound_to(predicate)), _Source(subjects, MappingPlan(subject_plan.subject_column, "", ()))
    columns = list(dict.fromkeys(rule.column for rule in rules))
    kinds = [links.types[name] for name in columns] + [known.types[subject_plan.subject_column]]
    whole = all(isinstance(kind, T.IntegralType) for kind in kinds)

    def key(source: _Source, name: str) -> Column:
        return _column(name).cast("long") if whole else source.text(name)

    # A column named by two rules links twice.
    cells = F.array(*[key(links, rule.column) for rule in rules])
    linked = links.rows.select(F.explode(cells).alias("key")).where(F.col("key").isNotNull())
    counted = linked.groupBy("key").agg(F.count("*").alias("reference_count"))
    held = known.rows.select(key(known, subject_plan.subject_column).alias("key")).distinct()
    plain = all(isinstance(kind, _PLAIN_TYPES) for kind in kinds)
    made = iri_template(subject_plan.subject_template, F.col("key").cast("string"), encode=not plain)
    return counted.join(held, "key", "left_anti").select(F.lit(predicate).alias("p"), made.alias("o"), "reference_count")
