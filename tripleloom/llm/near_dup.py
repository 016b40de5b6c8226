"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

1. Each text becomes the set of its distinct word shingles. One hash of each shingle picks a bin and a value in it; the
   least value of each bin is the signature. Empty bins borrow from bins that a second hash names (optimal
   densification). ``ROWS`` neighbouring bins make a band.
2. Texts with the same set are one class from here on; its smallest id stands for it.
3. Within a bucket of a band, every member is a candidate of the bucket's smallest member only: pairs grow with the
   members, not with their square.
4. Each centre and its candidates are compared on their full sets. Members of one star are also compared with each
   other, in blocks of bounded size, so that a link between two members is found although neither is the centre;
   only links that join what was apart are written. A star of more than one block first links to its centre; then
   only what that has not joined is compared further, and only where the distances to the centre differ by no more
   than a link allows (Jaccard distance obeys the triangle inequality, so nothing is lost).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import NO_ID, discard, hashes, ids_of, mixed, plain, rolled, ship, shuffle_parts, slices, stored, words_of
from .components import components

BINS, ROWS = 128, 4
#: Sets below this size get further permutations: with few filled bins, one permutation is one coin toss.
SMALL, EXTRA = 64, 2
BLOCK = 256


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a shorter text is one shingle, an empty one none."""
    found = words_of(pc.ascii_lower(texts))
    codes, distinct = found.coded()
    values = hashes(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
    runs = rolled(values, words)
    out = []
    for start, end in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()):
        if end - start >= words:
            out.append(np.unique(runs[start : end - words + 1]))
        elif end > start:
            short = np.uint64(end - start)
            out.append(mixed(np.array([xxhash.xxh64_intdigest(values[start:end].tobytes(), int(short))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each bin and whether the bin is filled; ``shingles`` sorted."""
    place = (shingles >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[place[first]] = shingles[first]
    filled[place[first]] = True
    return values, filled


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Rows of signatures with every empty bin filled from the first filled bin that its own hash sequence names."""
    values, bins, attempt = values.copy(), values.shape[1], 0
    row, column = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    while len(row):
        attempt += 1
        donor = (mixed(column.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = filled[row, donor]
        values[row[found], column[found]] = values[row[found], donor[found]]
        row, column = row[~found], column[~found]
    return values


def _bands(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Band keys of each set; sets that cannot reach any other at the threshold get none."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for turn in range(1 + EXTRA):
        which = [i for i, s in enumerate(sets) if len(s) and (turn == 0 or len(s) < SMALL)]
        if not which:
            continue
        salted = [sets[i] if turn == 0 else np.sort(mixed(sets[i] + np.uint64(turn))) for i in which]
        made = [signature(s) for s in salted]
        full = densified(np.stack([v for v, _ in made]), np.stack([f for _, f in made]))
        bands = full.reshape(len(which), BINS // ROWS, ROWS)
        keys = np.zeros(bands.shape[:2], np.uint64) + np.arange(BINS // ROWS, dtype=np.uint64) + np.uint64(turn << 16)
        for r in range(ROWS):
            keys = mixed(keys + bands[:, :, r])
        for i, key in zip(which, keys):
            out[i].append(key)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _signed(batches: Iterator[pa.RecordBatch], words: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(plain(batch.column("text")), words)
        bands = _bands([s if len(s) >= least else s[:0] for s in sets])
        digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids_of(batch.column("doc_id"))),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests[:, 0].copy()),
                pa.array(digests[:, 1].copy()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]), pa.int32()),
                    pa.array(np.concatenate(bands or [np.zeros(0, np.uint64)]).view(np.int64)),
                ),
            ],
            ["id", "n", "d1", "d2", "bands"],
        )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(column[start] for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, through a narrow strip of their incidence at a time."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[code] > 1
    number = np.cumsum(times > 1) - 1
    owner, code = owner[common], number[code[common]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((n, n), np.float64)
    for base in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [base, base + width])
        strip = np.zeros((n, width), np.float32)
        strip[owner[lo:hi], code[lo:hi] - base] = 1
        total += strip @ strip.T
    counts = np.rint(total).astype(np.int64)
    np.fill_diagonal(counts, [len(s) for s in sets])
    return counts


def _joining(ids: np.ndarray, roots: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Of the links ``near`` (a symmetric matrix), those that join parts not joined yet."""
    parent = {int(r): int(r) for r in roots}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(near & (roots[:, None] != roots[None, :]), 1)).tolist():
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _near(counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.diag(counts)
    union = size[:, None] + size[None, :] - counts
    return (100 * counts >= percent * union) & (union > 0), union


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.bool_())],
        ["u", "v", "distance", "linked"],
    )


_EDGE = "u long, v long, distance double, linked boolean"


def _star_blocks(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A centre with one block of its candidates: their distances if there are more blocks, and the links that join."""
    for group in grouped(batches, ["center", "block"]):
        ids, center = group["id"].to_numpy(), group["center"][0].as_py()
        sets = shingle_sets(plain(group["text"].combine_chunks()), words)
        counts = shared_counts(sets)
        near, union = _near(counts, percent)
        out = [(a, b, None, True) for a, b in _joining(ids, ids, near)]
        if group["blocks"][0].as_py() > 1:
            at = int(np.nonzero(ids == center)[0][0])
            out += [
                (center, int(ids[i]), 1 - counts[at, i] / max(1, union[at, i]), False) for i in range(len(ids)) if ids[i] != center
            ]
        yield _edges(out)


def _block_pairs(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for group in grouped(batches, ["center", "left", "right"]):
        ids, roots = group["id"].to_numpy(), group["root"].to_numpy()
        near, _ = _near(shared_counts(shingle_sets(plain(group["text"].combine_chunks()), words)), percent)
        yield _edges([(a, b, None, True) for a, b in _joining(ids, roots, near)])


def _dealt(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.repartition(shuffle_parts(frame.sparkSession), *keys).sortWithinPartitions(*keys)


def _rest_of_large_stars(spans: DataFrame, links: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links inside stars of several blocks that their centres do not give."""
    roots = components(links.select("u", "v"), "near-roots")
    member = spans.select(F.col("u").alias("center"), F.col("v").alias("id"), "distance")
    for column, name in (("id", "root"), ("center", "center_root")):
        member = member.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left")
        member = member.withColumn(name, F.coalesce(name, column))
    bin_width = 0.05
    reach = int((1 - percent / 100) / bin_width + 1e-9) + 1
    member = member.withColumn("bin", F.floor(F.col("distance") / bin_width).cast("int"))
    member = stored(member.withColumn("open", F.col("root") != F.col("center_root")).drop("center_root"), "near-members")
    sizes = member.groupBy("center", "open", "bin").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    block = F.concat_ws(":", F.when(F.col("open"), "o").otherwise("c"), "bin", "part")
    placed = (
        member.join(sizes.drop("size"), ["center", "open", "bin"])
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("block", block)
    )
    blocks = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", block)
    one = blocks.where("open").select("center", F.col("bin").alias("b1"), F.col("block").alias("left"))
    two = blocks.select("center", F.col("bin").alias("b2"), F.col("block").alias("right"), "open")
    pairs = one.join(two, "center").where((F.abs(F.col("b1") - F.col("b2")) <= reach) & (~F.col("open") | (F.col("left") <= F.col("right"))))
    ends = pairs.select("center", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    rows = placed.select("center", "block", "id", "root").join(ends, ["center", "block"]).join(texts, "id")
    return _dealt(rows.select("center", "left", "right", "id", "root", "text"), "center", "left", "right").mapInArrow(
        lambda batches: _block_pairs(batches, words, percent), _EDGE
    )


def confirmed(docs: DataFrame, signed: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the components that confirmed links make; nodes that are their own root are left out.

    ``docs`` has doc_id and text; ``signed`` has id, n, a digest d1, d2 of each set, and its band keys.
    """
    firsts = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("first"))
    classed = stored(signed.where("n > 0").select("id", "d1", "d2").distinct().join(firsts, ["d1", "d2"]).select("id", "first"), "near-classes")
    # One row of bands for each class, however many copies it has.
    of_class = signed.where(F.size("bands") > 0).join(classed.where("id = first").select("id").distinct(), "id", "left_semi")
    bucketed = of_class.select("id", F.explode("bands").alias("key"))
    centers = bucketed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last")
    pairs = bucketed.join(centers.drop("last"), "key").where("id != center").select("center", "id").distinct()
    pairs = stored(pairs, "near-pairs")

    wanted = pairs.select(F.col("center").alias("id")).union(pairs.select("id")).distinct()
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    texts = stored(source.join(wanted.hint("shuffle_hash"), "id", "left_semi"), "near-texts")

    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(sizes, "center").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    heads = sizes.select("center", F.col("center").alias("id"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = members.select("center", "id", "blocks", "block").union(heads).join(texts, "id")
    found = stored(
        _dealt(rows.select("center", "block", "blocks", "id", "text"), "center", "block").mapInArrow(
            lambda batches: _star_blocks(batches, words, percent), _EDGE
        ),
        "near-links",
    )
    links = found.where("linked")
    spans = found.where("not linked")
    if not spans.isEmpty():
        links = links.union(_rest_of_large_stars(spans, links, texts, words, percent).where("linked"))
    copies = classed.where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    edges = stored(links.select("u", "v").union(copies), "near-edges")
    discard(classed, pairs, texts, found)
    roots = components(edges, "near-components")
    discard(edges)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Two texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``words``-word shingles (A to Z
    in lower case; a text of fewer words is one shingle). ``component_id`` is the smallest id that links reach. Texts
    that are null or have no words have no shingles and no links. Rows that share an id are one node; a null id counts
    as one more id, smaller than all, and comes back as null. Other columns are not looked at and not returned.

    Equal sets are always linked. A pair of different texts at the threshold shares none of 32 bands of 4 bins with a
    probability below 1e-7; every pair that shares one is confirmed or refuted on full sets.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    # A set of n shingles can only be linked with another one if percent of its size leaves room for a difference.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 40
    signed = stored(
        docs.mapInArrow(lambda batches: _signed(batches, words, least), "id long, n long, d1 long, d2 long, bands array<long>"),
        "near-signatures",
    )
    roots = confirmed(docs, signed, words, percent)
    back = lambda c: F.when(c != NO_ID, c)
    return (
        signed.select("id", "n")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select(
            back(F.col("id")).alias("doc_id"),
            F.col("n").alias("n_shingles"),
            back(F.coalesce("root", "id")).alias("component_id"),
            F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
