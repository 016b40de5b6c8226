"""Queries over triples ``(graph, s, p, o, o_type, o_datatype, o_lang)``.

Patterns are joined as they are given; Spark chooses how. No join is hinted:
a side is broadcast when Spark has seen that it is small, and adaptive
execution splits the keys of hub nodes otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contains_ignoring_case, iri_label
from ..vocab import DRAW_LIMIT, FETCH_LIMIT, RDF_TYPE, TRIPLE_COLUMNS, XSD

TERM_ORDER = ("s", "p", "o", "o_type", "o_datatype", "o_lang")


@dataclass(frozen=True)
class Literal:
    """A literal used as a constant in a pattern or template."""

    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Pattern:
    """A triple with variables (``?name``). Other texts are IRIs; literals are :class:`Literal`."""

    s: str
    p: str
    o: str | Literal
    graph: str | None = None

    def cells(self) -> list[tuple[str, str | Literal]]:
        named = [("s", self.s), ("p", self.p), ("o", self.o)]
        return named if self.graph is None else [("graph", self.graph), *named]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(term[1:] for _, term in self.cells() if _is_variable(term)))


def _is_variable(term: str | Literal) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _kind(name: str) -> str:
    return f"{name}_kind"


def _object_kind() -> Column:
    """The full type of an object as one text, so that equal texts of unlike terms do not join."""
    literal = F.concat(
        F.lit("literal^"), F.coalesce("o_datatype", F.lit("")), F.lit("@"), F.coalesce("o_lang", F.lit(""))
    )
    return F.when(F.col("o_type") == "literal", literal).otherwise(F.col("o_type"))


def _matches(pattern: Pattern) -> Column:
    tests: list[Column] = []
    first_seen: dict[str, str] = {}
    for column, term in pattern.cells():
        if isinstance(term, Literal):
            tests += [F.col("o") == term.value, F.col("o_type") == "literal"]
            tests += [F.col("o_datatype") == term.datatype] if term.datatype is not None else []
            tests += [F.col("o_lang") == term.lang] if term.lang is not None else []
        elif not _is_variable(term):
            tests.append(F.col(column) == term)
            tests += [F.col("o_type") != "literal"] if column == "o" else []
        elif term in first_seen:
            tests.append(F.col(column) == F.col(first_seen[term]))
            tests += [F.col("o_type") != "literal"] if column == "o" else []
        else:
            first_seen[term] = column
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def triple_pattern(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """The triples a pattern matches, all columns kept."""
    return triples.where(_matches(pattern))


def bindings(
    triples: DataFrame, pattern: Pattern, resources: Iterable[str] = (), typed: Iterable[str] = ()
) -> DataFrame:
    """One column per variable. Variables in ``resources`` bind no literal; those in
    ``typed`` get a second column with the kind of term they bind.
    """
    found = triple_pattern(triples, pattern)
    resources, typed = set(resources), set(typed)
    columns: dict[str, Column] = {}
    for column, term in pattern.cells():
        if not _is_variable(term) or term[1:] in columns:
            continue
        name = term[1:]
        columns[name] = F.col(column).alias(name)
        if column == "o" and name in resources:
            found = found.where(F.col("o_type") != "literal")
        if name in typed:
            kind = _object_kind() if column == "o" else F.when(F.col(column).startswith("_:"), "bnode").otherwise("uri")
            columns[_kind(name)] = kind.alias(_kind(name))
    return found.select(*columns.values())


def order_patterns(patterns: Sequence[Pattern], predicate_counts: Mapping[str, int]) -> list[Pattern]:
    """Rarest predicate first, as counted by :func:`predicate_stats`; unknown ones last."""
    return sorted(patterns, key=lambda pattern: predicate_counts.get(pattern.p, float("inf")))


def merged(triples: DataFrame) -> DataFrame:
    """All graphs as one set: a triple that several of them hold is one triple here.

    Ask this where graphs may share triples; patterns over several graphs match
    a triple once for each graph that has it.
    """
    return triples.select(*TERM_ORDER).distinct().withColumn("graph", F.lit(None).cast("string")).select(*TRIPLE_COLUMNS)


def bgp_join(
    triples: DataFrame, patterns: Sequence[Pattern], typed: Iterable[str] = (), counts: Mapping[str, int] | None = None
) -> DataFrame:
    """All ways to match the patterns together, one column per variable.

    A variable that stands only for objects has its kind of term beside it
    (``name_kind``), so that later steps can tell literals from resources;
    :func:`solutions` drops the kinds in the end. With ``counts`` of predicates
    the rarest pattern comes first. Patterns must hang together through their
    variables. Parts that do not are separate questions, and pairing all their
    answers is refused.
    """
    if not patterns:
        raise ValueError("no pattern given")
    if counts is not None:
        patterns = order_patterns(patterns, counts)
    places: dict[str, list[str]] = {}
    for pattern in patterns:
        for column, term in pattern.cells():
            if _is_variable(term):
                places.setdefault(term[1:], []).append(column)
    resources = {name for name, columns in places.items() if set(columns) - {"o"}}
    wanted = (set(places) - resources) | set(typed)

    def bound(pattern: Pattern) -> DataFrame:
        return bindings(triples, pattern, resources=resources, typed=wanted)

    rest = list(patterns)
    joined = bound(rest.pop(0))
    while rest:
        known = set(joined.columns)
        position = next((i for i, pattern in enumerate(rest) if known & set(pattern.variables())), None)
        if position is None:
            raise ValueError("patterns share no variable; ask them as separate queries")
        right = bound(rest.pop(position))
        joined = joined.join(right, [name for name in joined.columns if name in right.columns], "inner")
    return joined


def solutions(found: DataFrame) -> DataFrame:
    """The variables alone, without their kinds."""
    return found.drop(*[_kind(name) for name in found.columns if _kind(name) in found.columns])


def _variables(found: DataFrame) -> list[str]:
    return [name for name in found.columns if not (name.endswith("_kind") and name.removesuffix("_kind") in found.columns)]


def _alike(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with kinds for every shared variable that one of them has a kind of, and the shared variables."""
    names = [name for name in _variables(left) if name in _variables(right)]
    for name in names:
        kind = F.when(F.col(name).startswith("_:"), "bnode").when(F.col(name).isNotNull(), "uri").alias(_kind(name))
        if _kind(name) in left.columns and _kind(name) not in right.columns:
            right = right.select("*", kind)
        if _kind(name) in right.columns and _kind(name) not in left.columns:
            left = left.select("*", kind)
    return left, right, names


def _by_bound(found: DataFrame, names: list[str], unbound: set[str]) -> list[tuple[DataFrame, list[str]]]:
    """``found`` in parts by which of the variables that may be null are bound, with the bound ones of each part."""
    parts = [(found, [name for name in names if name not in unbound])]
    for name in (n for n in names if n in unbound):
        parts = [
            part
            for frame, bound in parts
            for part in ((frame.where(F.col(name).isNotNull()), [*bound, name]), (frame.where(F.col(name).isNull()), bound))
        ]
    return parts


def _pairs(left: DataFrame, right: DataFrame, names: list[str], unbound: Iterable[str]):
    """For each part of the left side: the part, and the parts of the right side with the variables both have bound."""
    nullable = set(unbound)
    rights = _by_bound(right, names, nullable)
    for part, bound in _by_bound(left, names, nullable):
        yield part, [(other, [name for name in bound if name in known]) for other, known in rights]


def _columns_of(names: list[str], frame: DataFrame) -> list[str]:
    return [column for name in names for column in (name, _kind(name)) if column in frame.columns]


def optional(left: DataFrame, right: DataFrame, unbound: Iterable[str] = ()) -> DataFrame:
    """OPTIONAL: every left solution, extended where right ones are compatible.

    Name in ``unbound`` the shared variables that may be null on either side,
    after another OPTIONAL or a UNION: a null fits anything, and takes the
    other side's value. Each choice of bound ones is a join of its own, so the
    list should be short. If no shared variable is sure to be bound, all
    solutions could pair, which is refused.
    """
    unbound = set(unbound)
    left, right, names = _alike(left, right)
    if not set(names) - unbound:
        raise ValueError("OPTIONAL part shares no variable that is always bound")
    whole = list(dict.fromkeys([*left.columns, *right.columns]))
    made = []
    for part, others in _pairs(left, right, names, unbound):
        alone = part
        for other, keys in others:
            on = _columns_of(keys, part)
            taken = other.select(*[F.col(c).alias(c if c in on else f"_right_{c}") for c in other.columns])
            joined = part.join(taken, on, "inner" if len(others) > 1 else "left_outer")
            value = lambda c: (
                F.col(c) if c in on or c not in other.columns else F.col(f"_right_{c}") if c not in part.columns else F.coalesce(c, f"_right_{c}")  # noqa: B023
            )
            made.append(joined.select(*[value(c).alias(c) for c in whole]))
            if len(others) > 1:
                alone = alone.join(_keys(other, on), on, "left_anti")
        if len(others) > 1:
            made.append(alone.select(*[(F.col(c) if c in alone.columns else F.lit(None).cast(right.schema[c].dataType)).alias(c) for c in whole]))
    return reduce(DataFrame.unionByName, made)


def _keys(right: DataFrame, names: list[str]) -> DataFrame:
    """Each combination once: a hub that fills the right side is one row in a semi or anti join.

    The join uses the partitioning of this aggregation, so it adds no shuffle.
    """
    return right.select(*names).distinct()


def minus(left: DataFrame, right: DataFrame, unbound: Iterable[str] = ()) -> DataFrame:
    """MINUS: without solutions that are compatible with a right one and share a bound variable with it.

    ``unbound`` as for :func:`optional`; solutions that share nothing bound stay.
    """
    columns = left.columns
    left, right, names = _alike(left, right)
    made = []
    for part, others in _pairs(left, right, names, unbound):
        for other, keys in others:
            if keys:
                on = _columns_of(keys, part)
                part = part.join(_keys(other, on), on, "left_anti")
        made.append(part)
    return reduce(DataFrame.unionByName, made).select(*columns)


def _filtered(left: DataFrame, right: DataFrame, unbound: Iterable[str], wanted: bool) -> DataFrame:
    columns = left.columns
    left, right, names = _alike(left, right)
    made = []
    for part, others in _pairs(left, right, names, unbound):
        rest = part
        for other, keys in others:
            on = _columns_of(keys, part)
            if keys:
                if wanted:
                    made.append(rest.join(_keys(other, on), on, "left_semi"))
                rest = rest.join(_keys(other, on), on, "left_anti")
            elif not other.limit(1).isEmpty():
                # Nothing bound is shared: any right solution fits every left one.
                made += [rest] if wanted else []
                rest = rest.where(F.lit(False))
        made += [] if wanted else [rest]
    return reduce(DataFrame.unionByName, made).select(*columns) if made else left.where(F.lit(False)).select(*columns)


def exists(left: DataFrame, right: DataFrame, unbound: Iterable[str] = ()) -> DataFrame:
    """FILTER EXISTS: solutions with a compatible right one; ``unbound`` as for :func:`optional`."""
    return _filtered(left, right, unbound, True)


def not_exists(left: DataFrame, right: DataFrame, unbound: Iterable[str] = ()) -> DataFrame:
    """FILTER NOT EXISTS: solutions without a compatible right one."""
    return _filtered(left, right, unbound, False)


def union(*parts: DataFrame) -> DataFrame:
    """UNION: variables a part does not bind are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_k(solutions: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY … LIMIT … OFFSET …"""
    ordered = solutions.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


#: Datatypes whose literals count as numbers.
NUMERIC = [XSD + name for name in "integer decimal double float long int short byte nonNegativeInteger positiveInteger".split()]


def number(name: str, as_type: str = "double") -> Column:
    """Numeric value of a variable whose kind is at hand; null unless it is a literal of a numeric datatype."""
    kind = F.col(_kind(name))
    numeric = F.startswith(kind, F.lit("literal^")) & F.substring_index(F.substring_index(kind, "^", -1), "@", 1).isin(NUMERIC)
    return F.when(numeric, F.col(name).try_cast(as_type))


def object_number(as_type: str = "double") -> Column:
    """The same for the object of a triple."""
    return F.when((F.col("o_type") == "literal") & F.col("o_datatype").isin(NUMERIC), F.col("o").try_cast(as_type))


def construct(solutions: DataFrame, templates: Sequence[Pattern], graph: str) -> DataFrame:
    """CONSTRUCT: the triples the templates make of each solution, as a set.

    A triple with an unbound part is left out. An object variable is what its
    ``_kind`` says, and a resource where it stood for a subject or predicate.
    """

    def cell(term: str | Literal) -> Column:
        if isinstance(term, Literal):
            return F.lit(term.value)
        return F.col(term[1:]) if _is_variable(term) else F.lit(term)

    cells: list[Column] = []
    for template in templates:
        o_type, datatype, lang = F.lit("uri"), F.lit(None).cast("string"), F.lit(None).cast("string")
        if isinstance(template.o, Literal):
            o_type = F.lit("literal")
            datatype, lang = F.lit(template.o.datatype).cast("string"), F.lit(template.o.lang).cast("string")
        elif _is_variable(template.o) and _kind(template.o[1:]) in solutions.columns:
            kind = F.col(_kind(template.o[1:]))
            detail = F.substring_index(kind, "^", -1)
            o_type = F.substring_index(F.coalesce(kind, F.lit("uri")), "^", 1)
            is_literal = o_type == "literal"
            datatype = F.when(is_literal, F.nullif(F.substring_index(detail, "@", 1), F.lit("")))
            lang = F.when(is_literal, F.nullif(F.substring_index(detail, "@", -1), F.lit("")))
        cells += [cell(template.s), cell(template.p), cell(template.o), o_type, datatype, lang]
    made = solutions.select(F.stack(F.lit(len(templates)), *cells).alias(*TERM_ORDER)).dropna(subset=["s", "p", "o"])
    return made.withColumn("graph", F.lit(graph)).select(*TRIPLE_COLUMNS).distinct()


def describe_node(triples: DataFrame, node: str) -> DataFrame:
    """DESCRIBE: every triple with the resource as subject or object, in one pass."""
    about = (F.col("s") == node) | ((F.col("o") == node) & (F.col("o_type") != "literal"))
    return triples.where(about).select(*TRIPLE_COLUMNS).distinct()


# -- graphs and what a browser shows of them ---------------------------------------------------


def list_graphs(triples: DataFrame, containing: str = "") -> DataFrame:
    names = triples.select("graph").distinct()
    if containing:
        names = names.where(contains_ignoring_case(F.col("graph"), F.lit(containing)))
    return names.orderBy("graph")


def graph_sample(triples: DataFrame, graph: str, limit: int | None = FETCH_LIMIT) -> DataFrame:
    """The first triples of a graph in term order, or all of them."""
    ordered = triples.where(F.col("graph") == graph).orderBy(*TERM_ORDER)
    return ordered if limit is None else ordered.limit(limit)


_RESULT_DDL = (
    "head struct<vars:array<string>>, results struct<bindings:array<map<string,"
    "struct<type:string,value:string,datatype:string,`xml:lang`:string>>>>"
)


def bindings_rows(results: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Stored query results ``(result_id, json)`` as rows: per variable its value and type, or null."""
    parsed = results.select("result_id", F.from_json("json", _RESULT_DDL).alias("r"))
    rows = parsed.select("result_id", F.posexplode("r.results.bindings").alias("row_index", "cells"))
    columns = []
    for name in variables:
        found = F.try_element_at("cells", F.lit(name))
        columns += [found["value"].alias(name), found["type"].alias(f"{name}_type")]
    return rows.select("result_id", "row_index", *columns)


def bindings_variant(results: DataFrame) -> DataFrame:
    """Stored query results ``(result_id, json)`` as rows ``(result_id, row_index, cells)``, whatever their variables.

    ``cells`` maps each bound variable to a VARIANT, so results of different queries lie in one table and a variable is
    looked up when it is asked for (:func:`bound_cells`, :func:`cell`). What is no JSON, or no result, has no rows.
    """
    found = results.select("result_id", F.try_parse_json("json").alias("r"))
    rows = found.select("result_id", F.posexplode(F.try_variant_get("r", "$.results.bindings", "array<variant>")).alias("row_index", "row"))
    return rows.select("result_id", "row_index", F.try_variant_get("row", "$", "map<string,variant>").alias("cells"))


def cell(variable: str, part: str = "value") -> Column:
    """The value (or ``type``, ``datatype``, ``xml:lang``) of a variable in rows of :func:`bindings_variant`; null if unbound."""
    return F.try_variant_get(F.try_element_at("cells", F.lit(variable)), f'$["{part}"]', "string")


def bound_cells(rows: DataFrame) -> DataFrame:
    """Rows of :func:`bindings_variant` as ``(result_id, row_index, variable, value, type)``, one row a bound variable."""
    cells = rows.select("result_id", "row_index", F.explode("cells").alias("variable", "cell"))
    part = lambda name: F.try_variant_get("cell", f"$.{name}", "string").alias(name)
    return cells.select("result_id", "row_index", "variable", part("value"), part("type")).where(F.col("value").isNotNull())


def table_view(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows as a table shows them: nothing is an empty text."""
    return rows.select(*[F.coalesce(name, F.lit("")).alias(name) for name in variables])


def complete_triples(rows: DataFrame) -> DataFrame:
    """Rows that bind all of s, p and o; an empty object counts as bound."""
    return rows.dropna(subset=["s", "p", "o"])


def _drawn(triples: DataFrame, limit: int) -> DataFrame:
    """The first complete triples with their place. The window sees at most ``limit`` rows."""
    first = complete_triples(triples).orderBy(*TERM_ORDER).limit(limit)
    return first.withColumn("at", F.row_number().over(Window.orderBy(*TERM_ORDER)) - 1)


def graph_nodes(triples: DataFrame, limit: int = DRAW_LIMIT) -> DataFrame:
    """``(id, label, type)`` of the nodes to draw; the first appearance gives the type."""
    role = F.when(F.col("o_type") == "uri", F.lit("resource")).otherwise(F.lit("literal"))
    ends = _drawn(triples, limit).select(
        F.stack(F.lit(2), F.col("s"), F.lit("subject"), F.col("at") * 2, F.col("o"), role, F.col("at") * 2 + 1).alias(
            "id", "type", "seen"
        )
    )
    return (
        ends.groupBy("id")
        .agg(F.min_by("type", "seen").alias("type"))
        .select("id", iri_label(F.col("id")).alias("label"), "type")
    )


def graph_edges(triples: DataFrame, limit: int = DRAW_LIMIT) -> DataFrame:
    return _drawn(triples, limit).select(
        F.concat(F.lit("edge-"), F.col("at").cast("string")).alias("id"),
        F.col("s").alias("source"),
        F.col("o").alias("target"),
        F.col("p").alias("predicate"),
        iri_label(F.col("p")).alias("label"),
    )


def graph_counts(triples: DataFrame) -> DataFrame:
    """Triples per graph."""
    return triples.groupBy("graph").agg(F.count("*").alias("triple_count"))


def predicate_stats(triples: DataFrame) -> DataFrame:
    """Triples per predicate, with how many of them point at resources."""
    return triples.groupBy("p").agg(
        F.count("*").alias("triple_count"), F.count_if(F.col("o_type") == "uri").alias("resource_count")
    )


def node_degrees(triples: DataFrame) -> DataFrame:
    """Links out of and into each resource."""
    is_link = F.col("o_type") != "literal"
    ends = triples.select(
        F.stack(F.lit(2), F.col("s"), F.lit(1), F.lit(0), F.when(is_link, F.col("o")), F.lit(0), F.lit(1)).alias(
            "node", "leaves", "enters"
        )
    ).where(F.col("node").isNotNull())
    return ends.groupBy("node").agg(F.sum("leaves").alias("out_degree"), F.sum("enters").alias("in_degree"))


def class_counts(triples: DataFrame) -> DataFrame:
    """Typing triples per class; over a set of triples, its instances."""
    typing = triples.where((F.col("p") == RDF_TYPE) & (F.col("o_type") != "literal"))
    return typing.groupBy(F.col("o").alias("class_iri")).agg(F.count("*").alias("instance_count"))


# -- changes ------------------------------------------------------------------------------------


def join_triples(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on whole terms.

    The terms are compared as one struct, in which nulls are equal. Seven
    separate equalities over graphs of many branches take the optimizer seconds.
    """
    whole = F.struct(*TRIPLE_COLUMNS).alias("_triple")
    return left.select("*", whole).join(right.select(whole), "_triple", how).drop("_triple")


def insert_data(triples: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT DATA: a triple that is there already stays one triple.

    For a stored graph, :func:`.updates.insert_into` writes the new triples only.
    """
    return triples.select(*TRIPLE_COLUMNS).unionByName(new.select(*TRIPLE_COLUMNS)).distinct()


def delete_data(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """DELETE DATA: exact matches go, all parts of the term included."""
    return join_triples(triples, gone.select(*TRIPLE_COLUMNS).distinct(), "left_anti")


def delete_where(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """DELETE WHERE with one pattern: what it matches goes, in the same pass."""
    matched = _matches(pattern)
    return triples.where(~F.coalesce(matched, F.lit(False)))


def clear_graph(triples: DataFrame, graph: str) -> DataFrame:
    return triples.where(F.col("graph") != graph)
