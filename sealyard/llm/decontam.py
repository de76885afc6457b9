"""Benchmark decontamination: a broadcast hash set of the items' normalised n-grams, scanned over each document's words.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII. A window is n consecutive words
of an item; an item of fewer words, but not none, is one window of its own length. A document word inside any
occurrence of a window is hit. Windows that agree by hash are compared word by word before they count.

The set's size is checked: more than MAX_WINDOWS distinct windows are scanned for in several passes of bounded sets,
each ended by a checkpoint, so that no executor holds more than one of them.

Null and empty texts have no words, no hits, and are not contaminated. Null items have no windows. Repeated items each
count under their own id. Very long documents are hashed in parts of bounded memory. An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, cut, private, sliced, windows_hash, without, words_of

WINDOW = 13
#: Share of a document's words that must be hit for it to count as contaminated: one in so many.
ONE_IN = 20
#: Windows in one broadcast set, each of at most WINDOW words: some 100 MB at most.
MAX_WINDOWS = 500_000


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(item, words, gram) for each distinct window of each item; words are joined by a space, gram is their hash."""

    def cut_up(batches):
        for batch in batches:
            items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in words_of(texts, ALNUM):
                bounds = part.bounds()
                out = {}
                for i in range(part.count):
                    a, b = bounds[i], bounds[i + 1]
                    if a == b:
                        continue
                    size, data = min(n, b - a), texts[part.first + i].encode()
                    words = [data[s:e].decode().translate(_LOWER) for s, e in zip(part.start[a:b], part.end[a:b], strict=True)]
                    for k, gram in enumerate(windows_hash(part.hashes[a:b], size).view(np.int64).tolist()):
                        out[items[part.first + i], " ".join(words[k : k + size])] = gram
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["item", "words", "gram"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut_up, "item string, words string, gram long").distinct()


_LOWER = {c: c + 32 for c in range(65, 91)}


class _Grams:
    """A bounded set of windows, ready to be looked up: windows of one length by hash, and the items of each."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        by_words: dict[str, list] = {}
        for item, words, gram in rows:
            by_words.setdefault(words, [gram, []])[1].append(item)
        self.lengths = {}
        for length in sorted({w.count(" ") + 1 for w in by_words}):
            own = sorted((g, w, items) for w, (g, items) in by_words.items() if w.count(" ") + 1 == length)
            grams = np.array([g for g, _, _ in own], dtype=np.int64).view(np.uint64)
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[grams >> np.uint64(44)] = True
            self.lengths[length] = seen, grams[order], [own[k][1:] for k in order]

    def scan(self, part, texts, hit: np.ndarray) -> dict[int, set]:
        """Marks the hit words of a part; the items that occur in each of its texts."""
        found: dict[int, set] = {}
        for length, (seen, grams, what) in self.lengths.items():
            g = windows_hash(part.hashes, length)
            at = np.flatnonzero(seen[g >> np.uint64(44)])
            low = np.searchsorted(grams, g[at])
            fits = (low < len(grams)) & (grams[np.minimum(low, len(grams) - 1)] == g[at]) & (part.doc[at] == part.doc[at + length - 1])
            for p, k in zip(at[fits].tolist(), low[fits].tolist(), strict=True):
                i = int(part.doc[p])
                data = texts[part.first + i][1]
                words = b" ".join(data[s:e] for s, e in zip(part.start[p : p + length], part.end[p : p + length], strict=True)).decode("utf-8", "replace").translate(_LOWER)
                while k < len(grams) and grams[k] == g[p]:
                    if what[k][0] == words:
                        hit[p : p + length] = True
                        found.setdefault(i, set()).update(what[k][1])
                    k += 1
        return found


class _Lazy:
    """Texts that are encoded one at a time, when a hit in them is verified."""

    def __init__(self, texts):
        self.texts, self.last = texts, (-1, b"")

    def __getitem__(self, i):
        if self.last[0] != i:
            self.last = i, self.texts[i].encode()
        return self.last


def _runs(hit: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Byte spans from the first to the last word of each run of hit words."""
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return [[int(start[a]), int(end[b - 1])] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]



def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS, prefix: str = "hit_") -> DataFrame:
    """Adds to all columns of docs, with the prefix: n_words, n (words hit), items (sorted), spans (UTF-8 byte spans, end exclusive). Columns so named are replaced."""
    spark = docs.sparkSession
    grams = item_windows(benchmark, item, item_text, n)
    total = grams.count()
    passes = max(1, -(-total // max_windows))
    n_words, n_hit, items_, spans_ = new = [prefix + c for c in ("n_words", "n", "items", "spans")]
    kinds = dict(zip(new, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))), strict=True))
    docs = without(docs, *new)
    out = docs.withColumns({n_words: F.lit(None).cast("long"), n_hit: F.lit(0).cast("long"), items_: F.array().cast("array<string>"), spans_: F.array().cast("array<array<long>>")})
    for k in range(passes):
        rows = [tuple(r) for r in grams.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == k).collect()]
        shared = spark.sparkContext.broadcast(rows)
        names, schema = out.columns, out.schema

        def scan(batches, shared=shared, names=names):
            known = _Grams(shared.value)
            for batch in sliced(batches):
                texts = batch.column(text).to_pylist()
                before = [batch.column(names.index(c)).to_pylist() for c in (items_, spans_)]
                cols = {c: [] for c in new}
                for part in words_of(texts, ALNUM):
                    bounds, hit = part.bounds(), np.zeros(len(part.hashes), dtype=bool)
                    starts = part.start
                    for i in range(part.count):
                        for a, b in before[1][part.first + i] or ():
                            own = slice(bounds[i], bounds[i + 1])
                            hit[own] |= (starts[own] >= a) & (part.end[own] <= b)
                    found = known.scan(part, _Lazy(texts), hit)
                    sums = np.concatenate([[0], np.cumsum(hit)])[bounds]
                    cols[n_words] += np.diff(bounds).tolist()
                    cols[n_hit] += np.diff(sums).tolist()
                    for i in range(part.count):
                        own = slice(bounds[i], bounds[i + 1])
                        cols[items_].append(sorted({*(before[0][part.first + i] or ()), *found.get(i, ())}))
                        cols[spans_].append(_runs(hit[own], part.start[own], part.end[own]) if sums[i + 1] > sums[i] else [])
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], kinds[c]) if c in cols else batch.column(j) for j, c in enumerate(names)], names=names)

        out = out.mapInArrow(scan, schema)
        if passes > 1:
            out = cut(out)
            shared.unpersist()
    return out


def contaminated(one_in: int = ONE_IN, prefix: str = "hit_"):
    """At least one word in so many is hit."""
    n = F.col(f"{prefix}n")
    return (n > 0) & (n * one_in >= F.col(f"{prefix}n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", one_in: int = ONE_IN, **options) -> DataFrame:
    """docs without its contaminated documents, or with the hit spans taken out of every text (remove='spans')."""
    own = private(docs, "__hit_")
    found = find_windows(docs, benchmark, text, prefix=own, **options)
    if remove == "documents":
        return found.filter(~contaminated(one_in, own)).select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or not len(s):
                return t
            data, at, kept = t.encode(), 0, []
            for a, b in s:
                kept.append(data[at:a])
                at = b
            return b"".join([*kept, data[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return found.withColumn(text, cleaned(F.col(text), F.col(f"{own}spans"))).select(*[F.col(f"`{c}`") for c in docs.columns])
