"""Helpers shared by the operators: tables, checkpoints, ranks without hot partitions, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def private(df: DataFrame, prefix: str) -> str:
    """The prefix, with as many underscores before it as make it no column's."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; one of this machine only where the session names none and is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    return shared or tempfile.mkdtemp(prefix="sealyard-")


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """What a query has shuffled is of no more use once its rows are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the cluster's shared checkpoint folder; lineage ends there, and what led to them is let go."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with _shuffles_freed(spark):
        rows = df.select("*").checkpoint(eager=True)
    release(spark)
    return rows


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As `cut`, for wide rows: as compressed Parquet, and the folder, which `discard` deletes when its rows have been used."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def trim() -> None:
    """Gives back to the system what earlier tasks of this Python worker have freed; the C library would keep it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Lets the driver give back what earlier jobs leave: plans that Python still refers to, then broadcasts, shuffles and buffers, which Spark frees as they are collected.

    Last what its JVM has freed outside the heap, which the C library would keep: it grows with the jobs that have run. A JVM without that command keeps it.
    """
    gc.collect()
    trim()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def sliced(batches, rows: int = 1024):
    """Smaller record batches, so that what a task makes of one stays small."""
    trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()  # a worker that waits for its next task keeps nothing


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def md5_unit(*parts: Column) -> Column:
    """A number in (0, 1) drawn by the MD5 of the parts joined by ':'. 32 bits."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def ranked(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], name: str, of_group: DataFrame | None = None) -> DataFrame:
    """Adds `name`, a gapless number from 0 inside each group, in the order of (bucket, order).

    No task holds a whole group: rows are numbered inside (group, bucket), and the number of rows in the
    group's earlier buckets is added. The groups' columns must not be null; bucket is an integer, and each (group, bucket)
    should be of a size that one task can sort. Rows that tie on everything get the numbers in any order.
    of_group: more columns for each group, which travel with the counts, so that the rows are shuffled once only.
    """
    b, n = f"__{name}_bucket", f"__{name}_rows"
    df = df.withColumn(b, bucket.cast("long"))
    keys = [*groups, b]
    counts = df.groupBy(*keys).agg(F.count("*").alias(n))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(n, F.coalesce(F.sum(n).over(before), F.lit(0)))
    if of_group is not None:
        offsets = offsets.join(of_group, [*groups])
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(offsets, keys).withColumn(name, (F.col(name) - 1 + F.col(n)).cast("long")).drop(b, n)


# ---------------------------------------------------------------- words as 64-bit hashes

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for key, base in (("up", _PRIME), ("down", inverse)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[key] = np.cumprod(factors)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[0] = 0; the piece from i to j hashes to (c[j] - c[i]) * down[i], whatever comes before it."""
    up, _ = powers(len(data))
    c = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=c[1:])
    return c


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but white space; or digits, a-z and all beyond ASCII; or the latter without digits.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
#: Bytes that are hashed at once: some 100 bytes of memory each, while they are.
CHUNK = 1 << 17


class Words:
    """Lower-cased words of some whole texts: hash, number of the text, first byte and end in that text's UTF-8, and the first byte itself."""

    def __init__(self, first: int, count: int, doc, hashes, start, end, head):
        self.first, self.count, self.doc, self.hashes, self.start, self.end, self.head = first, count, doc, hashes, start, end, head

    def bounds(self) -> np.ndarray:
        """Words of text i are those from bounds[i] to bounds[i + 1]."""
        return np.searchsorted(self.doc, np.arange(self.count + 1))


def _hashed(data: bytes, table_: np.ndarray):
    buf = LOWER[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(table_[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    c = prefix_hash(buf)
    _, down = powers(len(buf))
    return start, end, mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64)), buf[start]


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about CHUNK bytes, cut at spaces, so that memory stays bounded; a longer word stays whole."""
    at = 0
    while len(data) - at > 2 * CHUNK:
        cut_at = data.find(b" ", at + CHUNK)
        if cut_at < 0:
            break
        yield at, data[at:cut_at]
        at = cut_at
    yield at, data[at:]


def words_of(texts: Sequence[str | None], table_: np.ndarray) -> Iterator[Words]:
    """Words of texts (null: none), some texts at a time; ASCII capitals are lowered."""
    group: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        group.append(data)
        size += len(data) + 1
        if size >= CHUNK or i + 1 == len(texts):
            if len(group) == 1 and len(data) > 2 * CHUNK:
                parts = [(s + at, e + at, h, b) for at, piece in _pieces(data) for s, e, h, b in [_hashed(piece, table_)]]
                start, end, hashes, head = (np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                start, end, hashes, head = _hashed(b"\n".join(group), table_)
            base = np.cumsum([0, *(len(x) + 1 for x in group)])
            doc = np.searchsorted(base, start, side="right") - 1
            yield Words(first, len(group), doc, hashes, start - base[doc], end - base[doc], head)
            group, first, size = [], i + 1, 0


def word_hashes(words: Sequence[str], table_: np.ndarray) -> np.ndarray:
    """The hashes that `words_of` gives to these words."""
    return np.concatenate([p.hashes for p in words_of([" ".join(words)], table_)])


def windows_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    g = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        g = g * _PRIME + hashes[k : k + len(g)]
    return mix(g)


# ---------------------------------------------------------------- joins and components without hot keys

#: A key with more than one in so many rows is hot; there are at most so many hot keys.
HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with `keyed`, which holds each key once and says in `count` how many of the `total` rows have it.

    The hot keys, at most HOT by their counts, are broadcast; no key of the others has more than total / HOT rows, so
    neither part leaves a task with a large share of the rows. rows is read twice.
    """
    hot = keyed.filter(F.col(count) * HOT > total)
    cold = keyed.filter(F.col(count) * HOT <= total)
    few = F.broadcast(hot.drop(count))
    return rows.join(few, [*keys]).unionByName(rows.join(F.broadcast(hot.select(*keys)), [*keys], "left_anti").join(cold.drop(count), [*keys]))


#: Edges that one task solves; more of them go through rounds of stars, until they are as few or done. And edges that a task reduces at once.
SMALL = CHUNK_EDGES = 1_000_000


def _least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the edges lead to: the smaller label of an edge's ends goes to both, then labels' labels are taken."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        for end in (u, v):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label, before):
            return label


def _stars(tables: list[pa.RecordBatch], centres: bool) -> pa.RecordBatch:
    """(u, v): the nodes of these edges, each with the smallest that they lead to; that one itself only with `centres`."""
    both = pa.concat_arrays([t.column(c) for c in range(2) for t in tables]).dictionary_encode()
    order = pc.array_sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    own = place[both.indices.to_numpy()]
    label = _least_reachable(own[: len(own) // 2], own[len(own) // 2 :], len(order))
    some = np.flatnonzero(centres | (label < np.arange(len(label))))
    return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[some])), both.dictionary.take(pa.array(order[label[some]]))], names=["u", "v"])


def _reduced(edges: DataFrame, centres: bool = False) -> DataFrame:
    """Edges (u, v) that connect what these do: each task's, CHUNK_EDGES at a time, as stars."""

    def run(batches):
        trim()
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK_EDGES and not centres:
                yield _stars(held, False)
                held, n = [], 0
        if held:
            yield _stars(held, centres)

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, small: int = SMALL, reduce_: bool = True) -> DataFrame:
    """(a, b) to (node, component): the smallest node that each can reach; nodes without an edge are left out.

    Tasks first reduce their own edges to stars, unless told that there is nothing to gain. At most `small` edges are then solved by one task. More of them alternate two steps
    until they are as few, or stars: every node's larger neighbours, then its smaller ones, are linked to the smallest that it
    knows. The number of rounds grows as the logarithm of the longest path.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(_reduced(e) if reduce_ else e)
    rows = e.count()
    while rows > small:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = cut(join_counted(both, least, ["u"], "n", 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        moved = join_counted(large, least, ["u"], "n", 2 * rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        children, rows = e.agg(F.count_distinct("u"), F.count("*")).first()
        # In a star forest each child has one parent, and no parent is a child.
        if children == rows and not e.join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return cut(_reduced(e.coalesce(1), centres=True)).select(F.col("u").alias("node"), F.col("v").alias("component"))
