"""Star patterns: several patterns about one subject, answered by one grouped pass and ordered by characteristic sets.

A characteristic set is the set of predicates that a subject has; subjects fall into few of them. Counting subjects and
triples by set gives close estimates of how many solutions a star has, which single predicate counts cannot give, as
predicates of one subject go together. The counts also say how many objects of a predicate one subject has at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import Pattern, _is_variable, _kind, _matches, _object_kind, bindings

#: Objects of one subject and predicate that may be held in one row; predicates with more are joined instead.
OBJECTS_PER_ROW = 1000


def characteristic_sets(triples: DataFrame) -> DataFrame:
    """``(predicates, subjects, triples, most)`` of each set of predicates that subjects have together.

    ``predicates`` is sorted; ``triples`` and ``most`` go with it: triples of the set's subjects with that predicate, and
    how many of them one subject has at most. Two shuffles: of subjects and predicates, then of counts by set. A row of a
    subject holds its predicates with a count each, so a subject with very many triples is a short row.
    """
    counted = triples.groupBy("s", "p").agg(F.count("*").alias("n"))
    own = counted.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("own"))
    placed = own.select(F.col("own.p").alias("predicates"), F.posexplode("own.n").alias("at", "n"))
    summed = placed.groupBy("predicates", "at").agg(F.count("*").alias("subjects"), F.sum("n").alias("triples"), F.max("n").alias("most"))
    listed = F.array_sort(F.collect_list(F.struct("at", "triples", "most")))
    return (
        summed.groupBy("predicates")
        .agg(F.max("subjects").alias("subjects"), listed.alias("cells"))
        .select("predicates", "subjects", F.col("cells.triples").alias("triples"), F.col("cells.most").alias("most"))
    )


def star_estimates(sets: DataFrame, stars: Sequence[Sequence[str]]) -> DataFrame:
    """One row: ``star_i`` is the expected number of solutions of star i, given by its predicates (repeats count).

    Subjects that have all predicates are counted exactly; objects of different predicates are taken as independent
    within a set.
    """
    columns = [F.coalesce(F.sum(_expected(star)), F.lit(0.0)).alias(f"star_{i}") for i, star in enumerate(stars)]
    return sets.agg(*columns)


def _cell(name: str, predicate: str) -> Column:
    """The set's number for a predicate, null if it lacks it."""
    return F.try_element_at(name, F.nullif(F.array_position("predicates", predicate), F.lit(0)).cast("int"))


def _expected(star: Sequence[str]) -> Column:
    shares = [_cell("triples", predicate) / F.col("subjects") for predicate in star]
    return reduce(Column.__mul__, shares, F.col("subjects").cast("double"))


def _in_star(pattern: Pattern) -> bool:
    fixed_graph = pattern.graph is None or not _is_variable(pattern.graph)
    return _is_variable(pattern.s) and not _is_variable(pattern.p) and fixed_graph


def bgp_star(
    triples: DataFrame,
    patterns: Sequence[Pattern],
    sets: DataFrame | None = None,
    typed: Iterable[str] = (),
    objects_per_row: int = OBJECTS_PER_ROW,
) -> DataFrame:
    """What :func:`.graph.bgp_join` finds, by one pass for each subject variable instead of one for each pattern.

    Patterns with a variable subject and a fixed predicate that share the subject are one star: the triples of its
    predicates are grouped by subject once, and a subject that has them all gives its solutions from that one row. Stars
    and other patterns are then joined, smallest estimate first. ``sets`` are the characteristic sets of the triples, as
    a stored table; without them they are counted for the predicates asked for. Results do not depend on ``sets``: they
    decide the order, and which predicates have too many objects of one subject to be held in a row
    (``objects_per_row``); those are joined as ordinary patterns, so that no row grows with the data.
    """
    if not patterns:
        raise ValueError("no pattern given")
    places: dict[str, list[str]] = {}
    for pattern in patterns:
        for column, term in pattern.cells():
            if _is_variable(term):
                places.setdefault(term[1:], []).append(column)
    resources = {name for name, columns in places.items() if set(columns) - {"o"}}
    wanted = (set(places) - resources) | set(typed)

    fixed = sorted({p.p for p in patterns if not _is_variable(p.p)})
    if sets is None:
        # Read twice below, and counted in one pass over the triples.
        sets = stored(characteristic_sets(triples.where(F.col("p").isin(fixed))), "characteristic-sets")
    most = sets.agg(F.lit(0).alias("_"), *[F.max(_cell("most", p)).alias(f"most_{i}") for i, p in enumerate(fixed)]).first()
    crowded = {p for i, p in enumerate(fixed) if (most[f"most_{i}"] or 0) > objects_per_row}

    units: dict[object, list[Pattern]] = {}
    for at, pattern in enumerate(patterns):
        key = pattern.s if _in_star(pattern) and pattern.p not in crowded else at
        units.setdefault(key, []).append(pattern)
    parts = list(units.values())
    known = [[p.p for p in part if not _is_variable(p.p)] for part in parts]
    expected = star_estimates(sets, known).first()
    # A pattern without a fixed predicate may match everything, so it comes last.
    order = sorted(range(len(parts)), key=lambda i: (len(known[i]) < len(parts[i]), expected[f"star_{i}"]))

    def found(part: list[Pattern]) -> DataFrame:
        return bindings(triples, part[0], resources, wanted) if len(part) == 1 else _star(triples, part, resources, wanted)

    rest = [parts[i] for i in order]
    joined = found(rest.pop(0))
    while rest:
        bound = set(joined.columns)
        position = next((i for i, part in enumerate(rest) if bound & {name for p in part for name in p.variables()}), None)
        if position is None:
            raise ValueError("patterns share no variable; ask them as separate queries")
        right = found(rest.pop(position))
        joined = joined.join(right, [name for name in joined.columns if name in right.columns], "inner")
    return joined


def _star(triples: DataFrame, patterns: Sequence[Pattern], resources: set[str], wanted: set[str]) -> DataFrame:
    """Solutions of patterns about one subject variable from one grouping by subject."""
    tests = []
    for pattern in patterns:
        test = _matches(pattern)
        if _is_variable(pattern.o) and pattern.o[1:] in resources:
            test &= F.col("o_type") != "literal"
        tests.append(test)
    asked = triples.where(F.col("p").isin(sorted({p.p for p in patterns})) & reduce(Column.__or__, tests))
    value = F.struct(F.col("o").alias("value"), _object_kind().alias("kind"))
    rows = asked.groupBy("s").agg(*[F.collect_list(F.when(test, value)).alias(f"_{i}") for i, test in enumerate(tests)])
    rows = rows.where(reduce(Column.__and__, [F.size(f"_{i}") > 0 for i in range(len(tests))]))
    for i in range(len(tests)):
        rows = rows.withColumn(f"_{i}", F.explode(f"_{i}"))

    subject = patterns[0].s[1:]
    columns: dict[str, Column] = {subject: F.col("s")}
    if subject in wanted:
        columns[_kind(subject)] = F.when(F.col("s").startswith("_:"), "bnode").otherwise("uri")
    first: dict[str, int] = {}
    for i, pattern in enumerate(patterns):
        if not _is_variable(pattern.o) or pattern.o == pattern.s:
            continue
        name = pattern.o[1:]
        if name in first:
            rows = rows.where(F.col(f"_{i}") == F.col(f"_{first[name]}"))
            continue
        first[name] = i
        columns[name] = F.col(f"_{i}.value")
        if name in wanted:
            columns[_kind(name)] = F.col(f"_{i}.kind")
    return rows.select(*[column.alias(name) for name, column in columns.items()])
