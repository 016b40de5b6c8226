"""Reachability by components: strongly connected nodes become one, and what is left has no cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored


#: Frames in one union; pairs of further levels go to a folder.
PARTS = 64


def _hashed(values: Column) -> Column:
    return F.xxhash64(values)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, entered, id)`` and the edges ``(u, v)`` between ids, each once; ``entered`` if an edge leads to a node.

    An id is the hash of its node, so edges meet no table of nodes. If two nodes have one hash, all are counted instead.
    """
    kind = edges.select(F.explode(F.array("source", "target")).alias("node")).schema["node"].dataType
    plain = edges.select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"))
    both = [F.struct(F.col(end).alias("node"), F.lit(end == "target").alias("entered")) for end in ("source", "target")]
    ends = plain.select(F.inline(F.array(*both))).groupBy("node").agg(F.max("entered").alias("entered"))
    nodes = stored(ends.withColumn("id", _hashed(F.col("node"))), "nodes")
    if nodes.groupBy("id").count().where("count > 1").isEmpty():
        return nodes, stored(plain.select(_hashed(F.col("source")).alias("u"), _hashed(F.col("target")).alias("v")).distinct(), "edges")
    nodes = stored(nodes.drop("id").withColumn("id", F.monotonically_increasing_id()), "nodes")
    of_source = nodes.select(F.col("node").alias("source"), F.col("id").alias("u"))
    of_target = nodes.select(F.col("node").alias("target"), F.col("id").alias("v"))
    return nodes, stored(plain.join(of_source, "source").join(of_target, "target").select("u", "v").distinct(), "edges")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges of which both ends lie on longer ways in both directions; a node on a cycle never loses its edges."""
    size = edges.count()
    while size:
        entered = edges.select(F.col("v").alias("u")).distinct()
        edges = stored(edges.join(entered, "u", "left_semi").select("u", "v"), "edges-trimmed")
        left = edges.select(F.col("u").alias("v")).distinct()
        edges = stored(edges.join(left, "v", "left_semi").select("u", "v"), "edges-trimmed")
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """``(node, colour)``: the smallest node from which each node is reached, itself included."""
    colours = stored(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        arriving = edges.join(colours, edges["u"] == colours["node"]).groupBy("v").agg(F.min("colour").alias("arrives"))
        least = F.least("colour", F.coalesce("arrives", "colour"))
        moved = colours.join(arriving, colours["node"] == arriving["v"], "left").select(
            "node", least.alias("colour"), (least < F.col("colour")).alias("changed")
        )
        colours = stored(moved, "colours")
        if colours.where("changed").isEmpty():
            return colours.select("node", "colour")
        colours = colours.select("node", "colour")


def _component_ids(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of nodes on cycles; a component is named after the smallest id of its nodes.

    Forward-backward colouring: every node takes the smallest node that reaches it. Nodes of one colour that lead back to
    the node their colour names are a component; edges between colours lie on no cycle. What is left begins anew.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([], "node long, component long")
    rest = _trimmed(edges.where("u != v"))
    while not rest.isEmpty():
        colours = _coloured(rest)
        of_u = colours.select(F.col("node").alias("u"), F.col("colour").alias("cu"))
        of_v = colours.select(F.col("node").alias("v"), F.col("colour").alias("cv"))
        same = stored(rest.join(of_u, "u").join(of_v, "v").where("cu = cv").select("u", "v", F.col("cu").alias("colour")), "edges-coloured")
        frontier = colours.where("node = colour").select("node", F.col("colour").alias("component"))
        marked = frontier
        while True:
            back = same.join(frontier.select(F.col("node").alias("v")), "v", "left_semi").select(F.col("u").alias("node"), F.col("colour").alias("component"))
            # Nodes, not pairs, are compared: each is marked once.
            frontier = stored(back.distinct().join(marked, "node", "left_anti"), "component-frontier")
            if frontier.isEmpty():
                break
            marked = marked.unionByName(frontier)
        marked = stored(marked, "component-marked")
        found = found.unionByName(marked)
        gone = marked.select("node")
        open_ones = same.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
        rest = _trimmed(stored(open_ones.select("u", "v"), "edges-open"))
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of edges ``(source, target)``; a component is named after its smallest node.

    A node on no cycle is a component of its own. Nulls are no nodes. Rounds grow with the longest way within a colour.
    """
    nodes, links = _numbered(edges.dropna(subset=["source", "target"]))
    cyclic = _cyclic(links)
    names = nodes.join(cyclic, "id").groupBy("component_id").agg(F.min("node").alias("component"))
    named = cyclic.join(names, "component_id").select("id", "component")
    return nodes.join(named, "id", "left").select("node", F.coalesce("component", "node").alias("component"))


def _cyclic(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` of nodes on cycles."""
    return stored(_component_ids(links).select(F.col("node").alias("id"), F.col("component").alias("component_id")), "components")


def _levels(edges: DataFrame) -> DataFrame:
    """``(id, level)`` of the nodes of an acyclic graph that an edge leads to: the longest way that ends in each."""
    levels = None
    entered, level = stored(edges.select(F.col("v").alias("id")).distinct(), "levels-open"), 1
    while not entered.isEmpty():
        edges = stored(edges.join(entered.withColumnRenamed("id", "u"), "u", "left_semi").select("u", "v"), "levels-edges")
        further = stored(edges.select(F.col("v").alias("id")).distinct(), "levels-open")
        settled = entered.join(further, "id", "left_anti").withColumn("level", F.lit(level))
        levels = settled if levels is None else levels.unionByName(settled)
        if level % PARTS == 0:
            levels = stored(levels, "levels")
        entered, level = further, level + 1
    return entered.withColumn("level", F.lit(0)) if levels is None else levels


def _swept(spark: SparkSession, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``(start, v)`` for every way in an acyclic graph, by one sweep over the levels of the nodes that are reached.

    Ways only lead to higher levels. So when a level's turn comes, all pairs that end in it are known: they are made
    distinct once, extended once, and no pair is ever compared with pairs of other rounds.
    """
    top = levels.agg(F.max("level").alias("top")).first().top or 0
    schema, out = "start long, v long, level int", "start long, v long"
    if not top:
        return spark.createDataFrame([], out)
    aimed_path, open_pairs, done = (scratch_path(spark, label) for label in ("edges-levelled", "pairs-open", "pairs"))
    edges.join(levels.withColumnRenamed("id", "v"), "v").select("u", "v", "level").write.partitionBy("level").parquet(aimed_path)
    aimed = spark.read.schema("u long, v long, level int").parquet(aimed_path)
    parts: list[DataFrame] = []
    for level in range(1, top + 1):
        here = aimed.where(F.col("level") == level).select(F.col("u").alias("start"), "v")
        if level > 1:
            # Only pairs of lower levels are extended, so the first level's are edges and nothing else.
            longer = spark.read.schema(schema).parquet(open_pairs).where(F.col("level") == level).select("start", "v")
            here = stored(here.unionByName(longer).distinct(), "pairs-level")
        parts.append(here)
        if level < top:
            further = here.select("start", F.col("v").alias("u")).join(aimed.where(F.col("level") > level), "u").select("start", "v", "level")
            further.write.mode("append").partitionBy("level").parquet(open_pairs)
        if len(parts) == PARTS:
            reduce(DataFrame.unionByName, parts).write.mode("append").parquet(done)
            parts = []
    held = [spark.read.schema(out).parquet(done)] if top >= PARTS else []
    return reduce(DataFrame.unionByName, held + parts)


def path_components(edges: DataFrame) -> DataFrame:
    """``(component, members, reached, reached_members)``: which strongly connected components edges lead to.

    The pairs of nodes that ``p+`` gives are the members of one side with the members of the other, so a component of
    a million nodes is one row here and 10**12 there. A component reaches itself if it has a cycle, or a link of a node
    to itself. Components are named after their smallest node; nulls are no nodes; no edges give no rows.
    """
    spark = edges.sparkSession
    nodes, links = _numbered(edges.dropna(subset=["source", "target"]))
    if nodes.isEmpty():
        return spark.createDataFrame([], f"component {edges.schema['source'].dataType.simpleString()}, members long, reached {edges.schema['source'].dataType.simpleString()}, reached_members long")
    cyclic = _cyclic(links)
    # Most nodes lie on no cycle: they are components as they are, without a shuffle.
    alone = nodes.join(cyclic, "id", "left_anti").select(F.col("id").alias("component_id"), F.lit(1).cast("long").alias("members"), F.col("node").alias("component"), "entered")
    groups = nodes.join(cyclic, "id").groupBy("component_id").agg(F.count("*").alias("members"), F.min("node").alias("component"), F.lit(True).alias("entered"))
    sizes = stored(alone.unionByName(groups), "component-sizes")
    between = links.join(cyclic.select(F.col("id").alias("u"), F.col("component_id").alias("cu")), "u", "left")
    between = between.join(cyclic.select(F.col("id").alias("v"), F.col("component_id").alias("cv")), "v", "left")
    between = stored(between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).distinct(), "component-edges")
    apart = between.where("u != v")
    levels = stored(_levels(apart), "component-levels")
    pairs = _swept(spark, apart, levels).unionByName(between.where("u = v").select(F.col("u").alias("start"), "v"))
    one = sizes.select(F.col("component_id").alias("start"), "component", "members")
    two = sizes.where("entered").select(F.col("component_id").alias("v"), F.col("component").alias("reached"), F.col("members").alias("reached_members"))
    # What many reach is met first, while rows are two numbers; starts are spread evenly.
    return pairs.join(two, "v").join(one, "start").select("component", "members", "reached", "reached_members")
