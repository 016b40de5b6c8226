"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is columns and aggregates: features are expressions, a level of a tree is one aggregate of gradients over
(node, feature, bin), and a trained model is an expression again. Only histograms reach the driver; their size depends
on the depth, the number of features and the number of bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.lookup import look_up

from .batches import lower_ascii, stored

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that trees are grown on at most (about: they are chosen by a hash), trees, levels, bins, and suffixes that
#: are part of the model's expression; all others are joined.
SAMPLE, TREES, DEPTH, BINS, SUFFIXES = 20_000, 12, 3, 16, 256
RATE, RIDGE = 0.3, 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that start with the rule's; written host, then path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def deciding_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null. Of equally long ones, the longer host."""
    fitting = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        fitting = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of a text's own character frequencies."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: sum_ - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(url: Column) -> dict[str, Column]:
    """Lexical features of a URL; null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.length(url).cast("double")
    return {
        "length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _times(path, "/[^/]"),
        "labels": _times(host, r"\.") + 1,
        "digit_ratio": F.when(n > 0, _times(url, "[0-9]") / n).otherwise(0.0),
        "sign_ratio": F.when(n > 0, _times(url, r"[^A-Za-z0-9]") / n).otherwise(0.0),
        "entropy": entropy(url),
        "parameters": F.when(F.length(query) > 0, _times(query, "[&;]") + 1).otherwise(0.0),
    }


class UrlModel(NamedTuple):
    """Log odds to start from, log odds of the most frequent suffixes and of a suffix never seen, trees as nested (feature,
    edge, low, high) or leaf values, and a table (suffix, odds) of all other suffixes, if there are any."""

    start: float
    suffixes: dict[str, float]
    other: float
    trees: list
    rest: DataFrame | None = None


def _rare_suffix(host: Column, suffixes: dict[str, float]) -> Column:
    """The suffix of a host where it is none of the frequent ones, so a look-up has no hot key."""
    own = suffix(host)
    return F.when(~own.isin(list(suffixes)), own) if suffixes else own


def _with_suffix(columns: dict[str, Column], host: Column, suffixes: dict[str, float], other: Column) -> dict[str, Column]:
    known = other
    if suffixes:
        known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair]), suffix(host)), known)
    return columns | {"suffix_odds": known}


def _value(tree, columns: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, edge, low, high = tree
    return F.when(columns[name] <= edge, _value(low, columns)).otherwise(_value(high, columns))


def probability(url: Column, model: UrlModel, rare: Column | None = None) -> Column:
    """The probability that a URL is to be blocked; ``rare`` holds the odds of a suffix out of the model's table, or null."""
    host, _ = host_and_path(F.coalesce(url, F.lit("")))
    other = F.lit(model.other) if rare is None else F.coalesce(rare, F.lit(model.other))
    columns = _with_suffix(features(url), host, model.suffixes, other)
    odds = reduce(lambda a, b: a + b, [_value(t, columns) for t in model.trees], F.lit(model.start))
    return 1 / (1 + F.exp(-odds))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, suffixes: int = SUFFIXES) -> UrlModel:
    """Fit on rows (url, blocked boolean): suffix statistics on all of them, trees on about ``sample``, chosen by a hash of the URL.

    Every suffix has its odds; the ``suffixes`` most frequent are part of the model's expression, all others a table. The
    sample sees the odds that the other half of all rows gives a suffix, so that a rare one does not tell its own label.
    Rows without url or label teach nothing. Without rows, or with one verdict only, the model has no trees and says
    what the smoothed share of blocked rows says.
    """
    rows = labelled.select("url", F.col("blocked").cast("double").alias("y")).where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    start = math.log((positive + 1) / (total - positive + 1))
    if positive in (0, total):
        return UrlModel(start, {}, 0.0, [])
    host, _ = host_and_path(F.col("url"))
    # Smoothed towards the share of all rows, so rare suffixes say little.
    share = positive / total
    odds_of = lambda n, y: F.log((y + 5 * share) / (n - y + 5 * (1 - share)))
    half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
    sums = [f(F.when(half == h, v)).alias(f"{name}{h}") for h in (0, 1) for name, f, v in (("n", F.count, F.col("y")), ("y", F.sum, F.col("y")))]
    counts = rows.groupBy(suffix(host).alias("suffix")).agg(*sums).fillna(0.0, ["y0", "y1"])
    counts = counts.select("suffix", (F.col("n0") + F.col("n1")).alias("n"), odds_of(F.col("n0") + F.col("n1"), F.col("y0") + F.col("y1")).alias("odds"),
                           odds_of(F.col("n1"), F.col("y1")).alias("odds0"), odds_of(F.col("n0"), F.col("y0")).alias("odds1"))
    counts = stored(counts, "url-suffixes")
    odds = {r.suffix: r.odds for r in counts.orderBy(F.desc("n"), "suffix").limit(suffixes).collect()}
    rest = counts.where(~F.col("suffix").isin(list(odds))).select("suffix", "odds")
    rest = None if rest.isEmpty() else rest
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < F.lit(int(sample / total * (1 << 20))))
    rows = stored(rows.withColumns({"half": half, "_suffix": suffix(host)}).repartition(4), "url-rows")
    met = rows.join(counts.select(F.col("suffix").alias("_suffix"), "odds0", "odds1"), "_suffix", "left")
    columns = features(F.col("url")) | {"suffix_odds": F.coalesce(F.when(F.col("half") == 0, F.col("odds0")).otherwise(F.col("odds1")), F.lit(start))}
    names = list(columns)
    table = stored(met.select("y", *[c.alias(n) for n, c in columns.items()]), "url-sample")
    levels = [i / bins for i in range(1, bins)]
    cuts = table.agg(*[F.percentile_approx(n, levels, 1000).alias(n) for n in names]).first().asDict()
    edges = {n: sorted(set(cuts[n] or [])) for n in names}
    numbers = [reduce(lambda a, b: a + b, [(F.col(n) > edge).cast("int") for edge in edges[n]], F.lit(0)) for n in names]
    binned = table.select("y", F.array(*numbers).alias("bins"))
    binned = stored(binned.coalesce(4), "url-bins")
    at = {n: F.col("bins")[i] for i, n in enumerate(names)}
    grown: list = []
    margin = F.lit(start)
    for _ in range(trees):
        p = 1 / (1 + F.exp(-margin))
        moved = binned.withColumn("g", p - F.col("y")).withColumn("h", p * (1 - p))
        tree: dict[int, tuple[str, int]] = {}
        leaves: dict[int, float] = {}
        for level in range(depth):
            node = F.lit(1)
            for number in sorted(tree):
                name, cut = tree[number]
                node = F.when(node == number, F.when(at[name] <= cut, 2 * number).otherwise(2 * number + 1)).otherwise(node)
            sums = moved.withColumn("node", node).select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            sums = sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            by_node: dict[int, list] = {}
            for r in sums:
                by_node.setdefault(r.node, []).append(r)
            for number, own in by_node.items():
                split = _best(own, names) if number >> level == 1 else None
                if split is None:
                    leaves.setdefault(number, _leaf([r for r in own if r.feature == 0]))
                    continue
                tree[number] = split
                low = [r for r in own if names[r.feature] == split[0] and r.bin <= split[1]]
                high = [r for r in own if names[r.feature] == split[0] and r.bin > split[1]]
                if level == depth - 1:
                    leaves[2 * number], leaves[2 * number + 1] = _leaf(low), _leaf(high)
            if not any(number >> level == 1 for number in tree):
                break
        binned_value = lambda number: (
            F.when(at[tree[number][0]] <= tree[number][1], binned_value(2 * number)).otherwise(binned_value(2 * number + 1))
            if number in tree
            else F.lit(float(leaves.get(number, 0.0)))
        )
        margin = margin + binned_value(1)
        nested = lambda number: (
            (tree[number][0], edges[tree[number][0]][tree[number][1]], nested(2 * number), nested(2 * number + 1)) if number in tree else leaves.get(number, 0.0)
        )
        grown.append(nested(1))
    return UrlModel(start, odds, start, grown, rest)


def _leaf(own: list) -> float:
    """The step of a leaf from its sums of gradients and curvatures."""
    return -RATE * sum(r.g for r in own) / (sum(r.h for r in own) + RIDGE)


def _best(own: list, names: list[str]) -> tuple[str, int] | None:
    """The split of a node with the largest gain, from its histogram."""
    total_g = sum(r.g for r in own if r.feature == 0)
    total_h = sum(r.h for r in own if r.feature == 0)
    base = total_g**2 / (total_h + RIDGE)
    best, choice = 1e-9, None
    for feature, name in enumerate(names):
        g = h = 0.0
        for r in sorted((r for r in own if r.feature == feature), key=lambda r: r.bin)[:-1]:
            g, h = g + r.g, h + r.h
            gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - base
            if gain > best:
                best, choice = gain, (name, r.bin)
    return choice


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score, from the column ``url``.

    The longest fitting rule decides; otherwise a probability of one half or more blocks. ``score`` is that
    probability, for all rows. A URL that is null or has no ``://`` has empty host and path and fits no rule with a
    host. Columns with the names of results are replaced, all others stay. The rules are literals of one expression,
    meant for up to some hundreds.
    """
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    # The caller's columns travel in one struct, so that no name clashes.
    results = ("host", "path", "rule", "verdict", "score")
    given = [name for name in pages.columns if name not in results]
    names = ["`" + name.replace("`", "``") + "`" for name in given]
    rows = pages.select(F.struct(*names).alias("row"), host.alias("host"), path.alias("path"))
    rare = None
    if model.rest is not None:
        rows = look_up(rows, _rare_suffix(F.col("host"), model.suffixes), model.rest, "suffix")
        rare = F.col("odds")
    found = deciding_rule(F.col("host"), F.col("path"), rules)
    url = next(F.col("row")[name] for name in given if name.lower() == "url")
    judged = rows.withColumn("found", found).withColumn("score", probability(url, model, rare))
    return judged.select(
        *[F.col("row")[name].alias(name) for name in given],
        "host",
        "path",
        F.col("found.text").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "score",
    )
