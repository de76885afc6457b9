"""Near duplicates by HyperMinHash: each bucket of a document's shingle hashes keeps the leading zeros and the next bits of its least.

1. One pass gives each document its set's size, a 128-bit digest of the set, and BUCKETS registers of 16 bits, banded ROWS
   to a band. Documents with equal sets are one class, which its smallest id stands for; copies never meet each other.
   An empty bucket borrows the register of another one, so that each band stands for ROWS shingles of a small set too.
2. The class of smallest id in a band is linked to the others in it, and the components of these links are clusters: two
   sets that share a band are in one cluster. Two sets of similarity 0.85 share none of the 48 bands with a probability of
   1e-10, of similarity 0.8, 5e-7.
3. Inside a cluster the pairs that share a band are compared, a block of classes by another in a task: first their registers, where an estimate
   corrected for chance collisions, and more than six deviations below the threshold, ends it; then the full sets. A pair
   that other links have joined is not compared. Only links that join something leave a task. A block has BLOCK classes, fewer if their
   sets are large, and its sets are of like size; blocks of sizes too far apart don't meet.
4. The components of these links are the result.

Words are runs without white space, ASCII capitals lowered. A set holds the distinct n-word shingles; of fewer words,
the whole sequence; without words (null, empty, blank), it is empty and linked with nothing. Shingles are equal if their
64-bit hashes are. Rows that share an id count as one document that has the links of all of them. Columns but the id and
the text pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _PRIME, NOT_SPACE, components, cut, join_counted, mix, ranked, sliced, trim, windows_hash, words_of

SHINGLE, SIMILARITY = 5, 80
BUCKETS, ROWS, MANTISSA = 288, 6, 10
#: Classes of a cluster that are compared with as many others in one task, if their sets have less than 2 * LARGE shingles; else fewer: the sets of a block take some 64 MB at most, or are one.
BLOCK, LARGE = 512, 8192
#: Pairs whose registers are looked at together.
TOGETHER = 4096
#: Pairs are left out on the registers alone if their estimate is so many deviations below the threshold.
DEVIATIONS = 6


def _sets(texts, n: int):
    """The sorted distinct shingle hashes of each text."""
    for part in words_of(texts, NOT_SPACE):
        bounds = part.bounds()
        grams = windows_hash(part.hashes, n)
        for i in range(part.count):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield windows_hash(part.hashes[a:b], b - a) if b > a else grams[:0]


def registers(hashes: np.ndarray) -> np.ndarray:
    """From sorted hashes: for each bucket 0 if empty, else the least one's leading zeros + 1, and the bits after its first one."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    bucket = ((hashes >> np.uint64(16)) * np.uint64(BUCKETS)) >> np.uint64(48)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(BUCKETS)))
    inside = hashes[first] * np.uint64(BUCKETS)  # the place inside the bucket, of 2**64
    zeros = np.minimum(64 - np.frexp(inside.astype(np.float64))[1], 62).astype(np.uint64)
    bits = (inside << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first].astype(np.int64)] = (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | bits).astype(np.uint16)
    return out


#: For each bucket an order of all buckets; an empty one borrows from the first in its order that isn't.
_ORDER = np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)


def bands(regs: np.ndarray) -> np.ndarray:
    """A hash of each ROWS registers, after empty ones have borrowed: else small sets would agree in bands for the few shingles there."""
    there = regs > 0
    empty = np.flatnonzero(~there)
    if len(empty):
        order = _ORDER[empty]
        regs = regs.copy()
        regs[empty] = regs[order[np.arange(len(empty)), there[order].argmax(axis=1)]]
    h = np.arange(BUCKETS // ROWS, dtype=np.uint64)
    for column in regs.reshape(-1, ROWS).T:
        h = h * _PRIME + column
    return mix(h)


def chance(n_a, n_b):
    """The probability that the registers of a bucket agree though the least hashes differ, for sets of n_a and n_b."""
    a, b = np.asarray(n_a, dtype=np.float64) / BUCKETS, np.asarray(n_b, dtype=np.float64) / BUCKETS
    rate, total, high = a + b, np.zeros(np.broadcast(a, b).shape), 1.0
    for _ in range(64):  # level by level, as all at once take 64 times the memory
        total += (np.exp(-rate * high / 2) - np.exp(-rate * high)) * (high / 2 / 2**MANTISSA)
        high /= 2
    return np.minimum(total * a * b / rate, 0.5)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
    """Similarity of each pair of rows as their registers show it, and the number of buckets that it rests on."""
    some = (regs_a | regs_b) > 0
    used, same = some.sum(axis=1), (some & (regs_a == regs_b)).sum(axis=1)
    p = chance(n_a, n_b)
    return (same / np.maximum(used, 1) - p) / (1 - p), used


def sketches(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, digest_a, digest_b, bands) of each row."""
    kind = docs.schema[key].dataType

    def run(batches):
        for batch in sliced(batches):
            size, one, two, regs = [], [], [], []
            for s in _sets(batch.column(1).to_pylist(), n):
                size.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                regs.append(bands(registers(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.list_(pa.int64()))], names=["key", "n_shingles", "digest_a", "digest_b", "bands"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, n_shingles long, digest_a long, digest_b long, bands array<long>")


def _common(sets_a: list, sets_b: list) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0/1 matrices over some thousand shingles at a time."""
    owner = np.concatenate([np.full(len(s), i) for i, s in enumerate([*sets_a, *sets_b])])
    values = np.concatenate([*sets_a, *sets_b])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total, step, a = np.zeros((len(sets_a), len(sets_b)), np.float32), 4096, len(sets_a)
    for low in range(0, len(names), step):
        own = slice(*np.searchsorted(column, [low, low + step]))
        there = np.zeros((a + len(sets_b), step), np.float32)
        there[owner[own], column[own] - low] = 1
        total += there[:a] @ there[a:].T
    return total


def _links(rows_a: list, rows_b: list, percent: int):
    """Links between two blocks of (id, set), or inside one if both are the same; only those that join."""
    inside, t = rows_a is rows_b, percent / 100
    sets_a, sets_b = ([r[1] for r in rows] for rows in (rows_a, rows_b))
    regs_a, regs_b = (np.array([registers(x) for x in sets]) for sets in (sets_a, sets_b))
    n_a, n_b = (np.array([len(x) for x in sets], dtype=np.float64) for sets in (sets_a, sets_b))
    bands_a, bands_b = (np.array([bands(x) for x in regs]) for regs in (regs_a, regs_b))
    shared = np.zeros((len(rows_a), len(rows_b)), dtype=np.uint8)
    for x, y in zip(bands_a.T, bands_b.T, strict=True):
        shared += x[:, None] == y[None, :]
    shared[100 * np.minimum(n_a[:, None], n_b[None, :]) < percent * np.maximum(n_a[:, None], n_b[None, :])] = 0
    i, j = np.nonzero(np.triu(shared, 1) if inside else shared)
    # The likeliest links first: most other pairs are joined by them.
    order = np.argsort(-shared[i, j].astype(np.int16), kind="stable")
    i, j, shift = i[order], j[order], 0 if inside else len(rows_a)
    joined, both, compared = np.arange(len(rows_a) + (0 if inside else len(rows_b))), None, 0
    for at in range(0, len(i), TOGETHER):
        x, y = i[at : at + TOGETHER], j[at : at + TOGETHER]
        apart = joined[x] != joined[y + shift]
        x, y = x[apart], y[apart]
        found, used = estimate(regs_a[x], regs_b[y], n_a[x], n_b[y])
        maybe = found >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
        for a, b in zip(x[maybe].tolist(), y[maybe].tolist(), strict=True):
            if joined[a] == joined[b + shift]:
                continue
            compared += 1
            if both is None and compared > 8 * (len(rows_a) + len(rows_b)):
                both = _common(sets_a, sets_b)
            common = both[a, b] if both is not None else len(np.intersect1d(sets_a[a], sets_b[b], assume_unique=True))
            if 100 * common >= percent * (len(sets_a[a]) + len(sets_b[b]) - common):
                joined[joined == joined[b + shift]] = joined[a]
                yield rows_a[a][0], rows_b[b][0]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component) of each row of docs: sets of similarity percent / 100 or more are linked, component is the smallest key that a row's links reach."""
    sk = cut(sketches(docs, key, text, n))
    digest = ["n_shingles", "digest_a", "digest_b"]
    some = sk.filter("n_shingles > 0 AND key IS NOT NULL")
    classes = cut(some.groupBy(*digest).agg(F.min("key").alias("rep"), F.count("*").alias("rows")))
    chosen = cut(some.select(F.col("key").alias("rep"), "bands", *digest).join(classes.select("rep", *digest), ["rep", *digest], "left_semi").select("rep", "bands"))

    banded = chosen.select("rep", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count("*").alias("n")).filter("a < z").drop("z"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    stars = join_counted(banded, shared, ["band"], "n", total).filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    members = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    # Blocks hold sets of one size, by powers of two from LARGE up; those of a cluster are numbered through, size after size.
    members = cut(members.join(classes.select("rep", F.floor(F.log2(F.greatest("n_shingles", F.lit(LARGE)) / LARGE)).cast("int").alias("kind")), "rep"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.pow(F.lit(2), F.col("kind"))).cast("long"))
    placed = ranked(members, ["cluster", "kind"], F.pmod(F.xxhash64("rep"), F.lit(64)), [F.col("rep")], "place").withColumn("block", F.floor(F.col("place") / fits))
    sizes = Window.partitionBy("cluster").orderBy("kind")
    near = sizes.rangeBetween(-1, 1) if percent > 50 else sizes.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = members.groupBy("cluster", "kind").agg(F.count("*").alias("n")).withColumn("own", F.ceil(F.col("n") / fits))
    blocks = blocks.withColumn("first", F.sum("own").over(sizes) - F.col("own"))
    blocks = cut(blocks.select("cluster", "kind", "n", "first", F.min("first").over(near).alias("from"), F.max(F.col("first") + F.col("own")).over(near).alias("to")))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    dealt = join_counted(placed.select("rep", "cluster", "kind", "block"), blocks, ["cluster", "kind"], "n", total)
    dealt = dealt.select("rep", "cluster", (F.col("first") + F.col("block")).alias("block"), F.explode(F.sequence("from", F.col("to") - 1)).alias("other"))
    dealt = dealt.select("rep", "block", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    sets = _full_sets(docs, members.select("rep"), key, text, n)
    full = dealt.join(sets, "rep")
    edges = _compare(full, docs.schema[key].dataType.simpleString(), percent)
    final = components(edges, reduce_=False).select(F.col("node").alias("rep"), "component")

    named = classes.join(final, "rep", "left").select(*digest, "rows", F.coalesce("component", "rep").alias("component"))
    total = named.agg(F.sum("rows")).first()[0] or 0
    keyed = join_counted(some, cut(named), digest, "rows", total).select("key", "n_shingles", "component")
    alone = sk.filter("n_shingles = 0 OR key IS NULL").select("key", "n_shingles", F.col("key").alias("component"))
    return keyed.unionByName(alone).withColumnRenamed("key", key)


def _full_sets(docs: DataFrame, reps: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(rep, full) with the sorted 64-bit hashes of each class that has to be compared."""

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1).to_pylist(), n)], pa.binary())], names=["rep", "full"])

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(reps, "rep", "left_semi")
    return own.mapInArrow(run, f"rep {kind}, full binary")


def _compare(full: DataFrame, kind: str, percent: int) -> DataFrame:
    """Links inside each pair of blocks; the pairs of blocks come one after another, so a task holds two blocks at most."""

    def run(batches):
        now, blocks = None, {}

        def done():
            if now is None:
                return
            low, high = now[1], now[2]
            if low == high and low in blocks:
                found = list(_links(blocks[low], blocks[low], percent))
            elif low in blocks and high in blocks:
                found = list(_links(blocks[low], blocks[high], percent))
            else:
                found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"])

        for batch in sliced(batches, 256):
            cols = [batch.column(c).to_pylist() for c in ("cluster", "low", "high", "block", "rep", "full")]
            for cluster, low, high, block, *row in zip(*cols, strict=True):
                if (cluster, low, high) != now:
                    yield from done()
                    now, blocks = (cluster, low, high), {}
                blocks.setdefault(block, []).append((row[0], np.frombuffer(row[1], dtype=np.uint64)))
        yield from done()
        blocks = {}
        trim()

    order = ["cluster", "low", "high"]
    return full.repartition(*order).sortWithinPartitions(*order, "block", "rep").mapInArrow(run, f"a {kind}, b {kind}")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates, that of smallest id; documents without words stay."""
    found = near_duplicates(docs, key, text, n, percent)
    gone = found.filter(F.col(key) != F.col("component")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
