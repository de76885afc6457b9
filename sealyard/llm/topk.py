"""Exact top-k by inner product without random access: sorted lists are read from their ends, and bounds say when to stop.

Candidates and queries are dealt to blocks by a hash of their id, so that every pair of blocks is one group of bounded size, whatever the
number of vectors. In a block each component has a list of its candidates, ordered by value. A query reads every list sequentially, from the end that
its own component's sign prefers, and adds up for each candidate what was read of it. Queries of a block read in step, from depth to depth: the entries
between two depths are one sparse matrix for each end of the lists, so what some queries read of them is a product, and nothing is read twice. At each
depth a candidate's score is at least what was read of it plus the least that its unread lists can give, and at most the same with the values
that the reading has reached. A query stops when the k-th greatest lower bound is above the upper bounds of all but a few; only
their scores are then resolved, in exact integers. The blocks' k best are merged by rank.

Components are floor(scale * x), x as double, of any finite size: the bounds are floating point and widened by what rounding can do, and scores
are summed in 64 bits, or in Python's integers where those could overflow. A score beyond a long counts as it is and is returned as the nearest long.
Vectors that are null or hold null or non-finite components take no part. A vector that is shorter than the longest counts as if zeros followed. Ties
go to the smaller id; repeated rows each count, as candidates and as queries. Fewer candidates than k give all. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Shares of the lists that have been read when the bounds are looked at; the share of a block's candidates that may be left to resolve; queries that read in step.
DEPTHS, LEFT, STEP = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1), 1 / 16, 256
_LONG = np.iinfo(np.int64)


def finite_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))


def integers(rows: list, width: int, scale: int) -> tuple[np.ndarray, list | None]:
    """floor(scale * x) of each component as a double, with zeros up to width; and exactly, where the scaled value is no finite double."""
    x = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        x[i, : len(row)] = row
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.isfinite(v).all():
        return v, None
    return v, [[math.floor(scale * y) if abs(y) < 2.0**52 else scale * int(y) for y in row] for row in x.tolist()]


class Lists:
    """A block's sorted lists: each component's values in ascending order, and each candidate's place in them, ties in order of place."""

    def __init__(self, v: np.ndarray):
        up = np.argsort(v, axis=0, kind="stable")
        self.v, self.values, self.size = v, np.take_along_axis(v, up, axis=0), len(v)
        self.place = np.empty(v.shape, dtype=np.int32)
        np.put_along_axis(self.place, up, np.arange(len(v), dtype=np.int32)[:, None], axis=0)
        self.least, self.most = self.values[0], self.values[-1]

    def read(self, done: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What the entries between two depths give beyond the list's worst: read from the greatest down, and from the least up."""
        down = np.where((self.place < self.size - done) & (self.place >= self.size - depth), self.v - self.least, 0.0)
        return down, np.where((self.place >= done) & (self.place < depth), self.most - self.v, 0.0)

    def reach(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What an entry that isn't read at this depth can give beyond the list's worst, and 0 for those that are."""
        down = np.where(self.place < self.size - depth, self.values[self.size - depth] - self.least, 0.0)
        return down, np.where(self.place >= depth, self.most - self.values[depth - 1], 0.0)


def nra(queries: np.ndarray, own: list[list[int]], lists: Lists, k: int, start: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the places of the candidates that can be among the k best, those in `own` apart, and how deep the lists were read. No look before `start`."""
    n, d = lists.size, queries.shape[1]
    plus, minus = np.maximum(queries, 0), np.maximum(-queries, 0)
    found: list = [None] * len(queries)
    depths = np.full(len(queries), n)
    with np.errstate(over="ignore", invalid="ignore"):
        lower = plus @ lists.least[:, None] - minus @ lists.most[:, None] + np.zeros(n)
        # Sums of products are off by no more than this.
        slack = 4 * (d + 2) * 2.0**-52 * (np.abs(queries) @ np.maximum(np.abs(lists.least), np.abs(lists.most)))
        for q, places in enumerate(own):
            lower[q, places] = -np.inf
            if not np.isfinite(slack[q]):
                found[q] = np.setdiff1d(np.arange(n), places)
        open_, done = np.array([q for q in range(len(queries)) if found[q] is None], dtype=np.int64), 0
        for depth in [x for x in sorted({min(n, max(k, math.ceil(share * n))) for share in DEPTHS}) if x >= min(start, n)]:
            if not len(open_):
                break
            p, m = plus[open_], minus[open_]
            down, up = lists.read(done, depth)
            now = lower[open_] + p @ down.T + m @ up.T
            lower[open_] = now
            upper = now
            if depth < n:
                down, up = lists.reach(depth)
                upper = now + p @ down.T + m @ up.T
            kth = np.partition(now, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
            inside = (upper + slack[open_, None] >= (kth - slack[open_])[:, None]) & (now > -np.inf)
            stop = (inside.sum(axis=1) <= max(4 * k, n * LEFT)) | (depth == n)
            for row in np.flatnonzero(stop).tolist():
                found[open_[row]] = np.flatnonzero(inside[row])
                depths[open_[row]] = depth
            open_, done = open_[~stop], depth
    return found, depths


def _scores(query: int, places: np.ndarray, asked, v: np.ndarray, wide: tuple[list, list] | None):
    """Exact scores of a query and the candidates in these places."""
    if wide is None and np.abs(v[places]).max(initial=0) * np.abs(asked[query]).sum() < 2.0**62:
        return v[places].astype(np.int64) @ asked[query].astype(np.int64)
    a = wide[0][query] if wide else [int(x) for x in asked[query].tolist()]
    b = [wide[1][i] for i in places.tolist()] if wide else [[int(x) for x in v[i].tolist()] for i in places.tolist()]
    return np.array([sum(x * y for x, y in zip(a, row, strict=True)) for row in b], dtype=object)


def best(queries: list, query_ids: np.ndarray, candidates: list, ids: np.ndarray, k: int, scale: int):
    """(query's place, candidate's place, score) of each query's k best in a block, and the share of the lists that was read."""
    width = max(map(len, [*queries, *candidates]))
    (asked, wide_a), (v, wide_v) = (integers(x, width, scale) for x in (queries, candidates))
    wide = None if wide_a is None and wide_v is None else tuple(w or [[int(x) for x in row] for row in m.tolist()] for w, m in ((wide_a, asked), (wide_v, v)))
    lists, out, read = Lists(v), [], 0
    where: dict = {}
    for i, x in enumerate(ids.tolist()):
        where.setdefault(x, []).append(i)
    # The first queries tell how deep this block's lists are read: looks well before that would be in vain.
    at, step, start = 0, STEP // 8, 0
    while at < len(queries):
        own = [where.get(x, []) for x in query_ids[at : at + step].tolist()]
        inside, depths = nra(asked[at : at + step], own, lists, k, start)
        read += int(depths.sum())
        for q, places in enumerate(inside, at):
            score = _scores(q, places, asked, v, wide)
            order = sorted(range(len(places)), key=lambda i: (-score[i], ids[places[i]]))[:k] if score.dtype == object else np.lexsort((ids[places], -score))[:k]
            out += [(q, int(places[i]), int(score[i])) for i in order]
        at, step, start = at + step, STEP, int(depths.min()) * 3 // 4
    return out, read / max(1, len(queries) * len(ids))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k rows of vectors, but for its own id, of greatest score."""
    base, asked = cut(finite_vectors(vectors, key, vector)), cut(finite_vectors(queries, key, vector))
    blocks, query_blocks = (max(1, -(-x.count() // n)) for x, n in ((base, block), (asked, query_block)))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("id", "v", deal("candidate", blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit(-1).cast("long").alias("row"))
    asked = asked.withColumn("row", F.monotonically_increasing_id())  # of written rows, so the numbers stay
    right = asked.select("id", "v", every(blocks).alias("block"), deal("query", query_blocks).alias("query_block"), "row")
    kind = base.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, row, v = group["id"].to_numpy(), group["row"].to_numpy(), group["v"]
        is_query = row >= 0
        if is_query.all() or not is_query.any():
            return pd.DataFrame({"row": row[:0], "query_id": ids[:0], "id": ids[:0], "score": pd.Series(dtype=object), "high": pd.Series(dtype=object)})
        q_ids, c_ids = ids[is_query], ids[~is_query]
        found, _ = best(v[is_query].tolist(), q_ids, v[~is_query].tolist(), c_ids, k, scale)
        a, b = (np.array([f[i] for f in found], dtype=np.int64) for i in range(2))
        # Scores beyond a long are merged by their text: sign and length, then digits.
        return pd.DataFrame({"row": row[is_query][a], "query_id": q_ids[a], "id": c_ids[b], "score": [min(max(s, _LONG.min), _LONG.max) for *_, s in found], "high": [_sortable(s) for *_, s in found]})

    near = left.unionByName(right).groupBy("block", "query_block").applyInPandas(run, f"row long, query_id {kind}, id {kind}, score long, high string")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.desc_nulls_last("high"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _sortable(score: int) -> str | None:
    """For scores that no long holds, a text that sorts as they do; null for others."""
    if _LONG.min <= score <= _LONG.max:
        return None
    digits = str(abs(score)).zfill(700)
    return f"1{digits}" if score > 0 else f"0{digits.translate(str.maketrans('0123456789', '9876543210'))}"
