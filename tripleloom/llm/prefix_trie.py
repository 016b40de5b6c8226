"""Prefix trie of conversations by collapsing whole sequences.

1. Turns travel as two 64-bit hashes of role and text and the text's length; the texts themselves are never shuffled.
   Every conversation is rebuilt from the first turns of its group's first conversation and its own later turns.
2. The hash of a prefix is the exclusive or of its turns' hashes, each taken with its place, so it is a running column
   (``running.py``) and the parent's hash is the node's without its last turn. 128 bits and the depth stand for a node.
3. Whole-sequence collapse: identical rebuilt conversations become one sequence with a weight, its smallest id and the
   list of ids that end there. From here on only one conversation of each sequence is looked at.
4. Sequences that are proper prefixes of others are dropped by an anti-join; what is left are the leaves.
5. Nodes are aggregates of weighted prefixes. What a subtree adds up is turned into sums along sequences: every node
   belongs to the sequence of its smallest member, so the sum over a subtree is the sum, over the sequences through it, of
   what they own from there on, again a running column. No step lists a node's ancestors or a subtree's nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import ship, shuffle_parts, stored
from .running import SUM, XOR, running

#: Conversations whose numbers differ in the last of these share the first turns of the first of them.
GROUP, KINDS = 5, 9
#: Digits of ids that travel as one text.
CHUNK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its group's first one, at most."""
    return F.crc32(conv_id.cast("string").cast("binary")) % KINDS


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence as comma-joined texts of bounded length; rows come sorted by sequence and id."""

    def made(parts: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*parts))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["length", "p1", "p2", "first", "n", "ids"])

    key, first, ids, size = None, 0, [], 0
    for batch in batches:
        out = []
        length, p1, p2, conv = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("length", "p1", "p2", "conv_id"))
        for own, c in zip(zip(length, p1, p2), conv):
            if own != key or size > CHUNK:
                if ids:
                    out.append((*key, first, len(ids), ",".join(ids).encode()))
                key, first, ids, size = own, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield made(out)
    if ids:
        yield made([(*key, first, len(ids), ",".join(ids).encode())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a sequence from its chunks in order; only the state of the hash is held."""
    names = ["length", "p1", "p2", "first", "n", "ids"]
    key, first, weight, digest = None, 0, 0, None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
            ["length", "p1", "p2", "first", "weight", "ends_sha256"],
        )

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:3] != key:
                if digest is not None:
                    out.append((*key, first, weight, digest.hexdigest()))
                key, first, weight, digest = row[:3], row[3], 0, hashlib.sha256()
            elif digest is not None:
                digest.update(b",")
            digest.update(row[5])
            weight += row[4]
        if out:
            yield made(out)
    if digest is not None:
        yield made([(*key, first, weight, digest.hexdigest())])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, h1, h2, bytes), and every conversation with its rebuilt length.

    ``turns`` has conv_id without null, turn, h1, h2, bytes and a number that tells equal rows apart.
    """
    order = [F.col(c) for c in ("turn", "h1", "h2", "tie")]
    placed = running(turns.withColumn("one", F.lit(1).cast("long")), "conv_id", order, {"pos": ("one", SUM)}, "trie-places")
    placed = placed.select("conv_id", "pos", "h1", "h2", "bytes")
    conv = F.col("conv_id")
    base, asked = conv - conv % GROUP, shared_turns(conv)
    convs = stored(placed.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", base), "trie-conversations")
    of_base = convs.select(conv.alias("base"), F.col("own").alias("there"))
    sized = stored(
        convs.join(of_base, "base", "left")
        .withColumn("shared", F.least(asked, F.coalesce("there", F.lit(0))))
        .select("conv_id", "shared", (F.col("shared") + F.greatest(F.col("own") - asked, F.lit(0))).alias("length")),
        "trie-lengths",
    )
    heads = placed.where((conv % GROUP == 0) & (F.col("pos") < KINDS)).withColumnRenamed("conv_id", "head")
    taken = (
        heads.withColumn("conv_id", F.explode(F.sequence(F.col("head") - (GROUP - 1), F.col("head") + (GROUP - 1))))
        .where((base == F.col("head")) & (F.col("pos") <= asked))
        .join(sized.select("conv_id"), "conv_id")
        .select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "bytes")
    )
    later = (
        placed.where(F.col("pos") > asked)
        .join(sized.select("conv_id", "shared"), "conv_id")
        .select("conv_id", (F.col("shared") + F.col("pos") - asked).alias("depth"), "h1", "h2", "bytes")
    )
    return taken.union(later), sized


def sequences(prefixes: DataFrame, sized: DataFrame) -> DataFrame:
    """Distinct whole sequences: length, p1, p2, their smallest id, how many end there, and the digest of those ids."""
    last = prefixes.select("conv_id", F.col("depth").alias("length"), "p1", "p2")
    zero = F.lit(0).cast("long")
    whole = sized.select("conv_id", "length").join(last, ["conv_id", "length"], "left")
    whole = whole.select("length", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), "conv_id")
    parts, key = shuffle_parts(sized.sparkSession), ["length", "p1", "p2"]
    # Ids are sorted and joined to long texts by ranges, so a sequence that very many share lies in several tasks; a
    # digest is a chain, so a sequence's texts, a few bytes an id, then pass one task in their order.
    chunks = whole.repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = chunks.mapInArrow(_chunks, "length long, p1 long, p2 long, first long, n long, ids binary")
    dealt = chunks.repartition(parts, *key).sortWithinPartitions(*key, "first")
    return stored(dealt.mapInArrow(_sequences, "length long, p1 long, p2 long, first long, weight long, ends_sha256 string"), "trie-sequences")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations; ``conversations`` has conv_id, turn, role and text.

    Turns are ordered by ``turn`` (null first); rows with the same turn stand in an order that a hash of role and text
    fixes, and rows repeated whole are turns of their own. Null roles and texts are empty. Rows without conv_id belong
    to no conversation and are left out. Conversation c takes the first h turns of conversation c - c % 5 (all if there
    are fewer, none if that is absent) and its own turns after its first h, h = crc32(decimal c) % 9; remainders have the
    sign of c. Other columns are neither looked at nor returned, whatever their names. An empty table has no nodes, not
    even a root.

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text) and ends_sha256 (of the ids
    that end there, ascending, joined by commas). A node is known by its depth and 128 bits of hashes.
    """
    ship(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = stored(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            F.xxhash64(role, text).alias("h1"),
            F.xxhash64(F.lit("second"), text, role).alias("h2"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "trie-turns",
    )
    steps, sized = rebuilt(turns)
    steps = steps.select(
        "conv_id", "depth", "bytes", F.xxhash64("depth", "h1", "h2").alias("m1"), F.xxhash64("h2", "depth", "h1").alias("m2")
    )
    prefixes = running(steps, "conv_id", [F.col("depth")], {"p1": ("m1", XOR), "p2": ("m2", XOR)}, "trie-prefixes")
    whole = sequences(prefixes, sized)

    # Paths of one conversation a sequence, the root included.
    zero = F.lit(0).cast("long")
    chosen = whole.select(F.col("first").alias("conv_id"), "weight", "length")
    columns = ["conv_id", "depth", "bytes", "m1", "m2", "p1", "p2", "weight", "length"]
    roots = chosen.select("conv_id", *(zero.alias(c) for c in columns[1:7]), "weight", "length")
    paths = stored(prefixes.join(chosen, "conv_id").select(columns).union(roots), "trie-paths")

    node = ["depth", "p1", "p2"]
    inner = paths.where("depth < length").select(node).distinct()
    leaves = whole.withColumnRenamed("length", "depth").join(inner, node, "left_anti")
    leaves = leaves.select(F.col("first").alias("conv_id"), "depth", F.lit(1).cast("long").alias("leaf"))
    owned = (
        paths.groupBy(node)
        .agg(F.min("conv_id").alias("conv_id"), ((F.sum("weight") - 1) * F.max("bytes")).alias("value"))
        .select("conv_id", "depth", "value", F.lit(1).cast("long").alias("owned"))
    )
    marked = paths.join(owned, ["conv_id", "depth"], "left").join(leaves, ["conv_id", "depth"], "left")
    marked = marked.select(columns + [F.coalesce(c, zero).alias(c) for c in ("value", "owned", "leaf")])
    sums = {"saved": ("value", SUM), "leaves": ("leaf", SUM), "from_here": ("owned", SUM)}
    summed = running(marked, "conv_id", [F.desc("depth")], sums, "trie-sums")
    # What a sequence owns is the end of its path: it owns the next node if it owns all that follow.
    child = (F.col("length") > F.col("depth")) & (F.col("from_here") - F.col("owned") == F.col("length") - F.col("depth"))
    nodes = stored(
        summed.groupBy(*node, F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2")).agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.count_if(child).alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        ),
        "trie-nodes",
    )
    # The root is every first turn's parent, so it is not looked up; the root itself looks up nothing.
    least = sized.agg(F.min("conv_id")).first()[0]
    parents = nodes.where("depth > 0 and n_children > 0").select(
        (F.col("depth") + 1).alias("level"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above")
    )
    deep = F.col("depth") > 1
    asked = nodes.withColumns(
        {"level": F.when(deep, F.col("depth")).otherwise(-1), "q1": F.when(deep, F.col("q1")).otherwise(F.col("p1")), "q2": F.when(deep, F.col("q2")).otherwise(F.col("p2"))}
    )
    ends = whole.select(F.col("length").alias("depth"), "p1", "p2", "ends_sha256")
    return (
        asked.join(parents, ["level", "q1", "q2"], "left")
        .join(ends, node, "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("above")).cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )
