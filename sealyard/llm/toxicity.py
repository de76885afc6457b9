"""Toxicity by two Kneser-Ney models of how words are spelled, one learned from toxic texts and one from the others.

Texts are lower-cased. A letter is predicted from those before it in its word, up to ORDER - 1 bytes. Each class's model discounts its own counts and
gives what that frees, and STRENGTH pseudo-counts, to a Kneser-Ney model of both classes together, so that a rare
expression gets nearly the same probability from both and says nothing; the larger class's counts are scaled down to the
smaller one's. Log-likelihoods are compared per word: over the text, over what passes MARGIN in each word, and over the
window of WINDOW words where the toxic model does best. A logistic curve, fitted to the labelled texts of each fold as
the counts of the other folds see them, turns the three into a probability.

All labelled rows are learned from, and all their letter sequences count. The model is dealt to parts of some PART sequences by
the three bytes before the letter, so that all that is known of a letter's orders from SHARED up is in one part; of the lower orders only the shared
probabilities of three bytes are needed. Parts are built in tasks and broadcast one by one. A task takes the distinct words of some texts and loads the
parts in turn, so neither the driver nor a worker holds more than one of them. Labels of rows in fold 2
are never read. Null and empty texts have no words and get the score of no evidence. Several labels of one id count as the
highest; null labels don't count. Without labels of both classes every score is the share of toxic labels (0 if none).
Whole texts are scored, in parts of bounded memory; extra columns pass through.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, CHUNK, LOWER, _hashed, cut, fold, private, release, sliced, trim, without

ORDER, SHARED, WINDOW, DISCOUNT, STRENGTH, MARGIN, FLOOR, ECHO = 8, 4, 16, 0.75, 8, 1.0, 0.002, 4
#: Sequences in a part of the model; bytes of text whose words are looked up together; labels that are broadcast, more are joined by a shuffle.
PART, GROUP, FEW = 250_000, 1 << 22, 1_000_000
THRESHOLD = 0.3
_BYTE = np.uint64(8)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * order) - 1)


def _grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a word the ORDER bytes up to it, none from before the word, as a number; whether it begins a word; its place."""
    buf = LOWER[np.frombuffer(data, dtype=np.uint8)]
    buf = np.where(LETTERS[buf], buf, np.uint8(0))
    at = np.flatnonzero(buf)
    key, inside = buf[at].astype(np.uint64), np.ones(len(at), dtype=bool)
    first = None
    for back in range(1, ORDER):
        before = np.where(at >= back, buf[np.maximum(at - back, 0)], np.uint8(0))
        inside &= before > 0
        if first is None:
            first = ~inside
        key |= np.where(inside, before, np.uint8(0)).astype(np.uint64) << np.uint64(8 * back)
    return key, first, at


def _parts(data: bytes, size: int = CHUNK):
    """A text in parts that end at a space or line, if there is one after `size` bytes."""
    at = 0
    while len(data) - at > 2 * size:
        ends = [e for e in (data.find(b" ", at + size), data.find(b"\n", at + size)) if e >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:]


def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a table of ascending keys, 0 for unknown keys, and which keys are known. Key 0 is unknown."""
    own, values = table
    if not len(own):
        return np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    known = (own[at] == keys) & (keys != 0)
    return np.where(known, values[at], np.float32(0)), known


def _part(keys, parts: int):
    """The part of each sequence, by the three bytes before its last one. `_part_column` says the same in SQL."""
    spread = (((keys >> _BYTE) & np.uint64(0xFFFFFF)) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    return ((spread >> np.uint64(12)) % np.uint64(parts)).astype(np.int64)


def _part_column(gram, parts: int):
    return F.expr(f"cast(shiftright((shiftrightunsigned(`{gram}`, 8) & 16777215L) * 2654435761L & 4294967295L, 12) % {parts} as int)")


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, top: int = ORDER, low: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order, the sequences and the probability of their last byte after the others, interpolated down to a uniform byte.

    With `low`, the sequences of order SHARED - 1 and their probabilities, only from SHARED up.
    """
    least = 1 if low is None else SHARED
    levels = {top: (keys, counts)}
    for order in range(top - 1, least - 1, -1):  # continuation counts: distinct longer sequences that end so
        longer = levels[order + 1][0]
        levels[order] = np.unique(longer & _mask(order), return_counts=True)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {} if low is None else {SHARED - 1: low}
    for order in range(least, top + 1):
        own, c = levels[order]
        context, where = np.unique(own >> _BYTE, return_inverse=True)
        total, types = np.bincount(where, weights=c), np.bincount(where)
        below = out[order - 1][1][np.searchsorted(out[order - 1][0], own & _mask(order - 1))] if order > 1 else 1 / 256
        out[order] = own, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * types[where] * below) / total[where]
    return out


class Model:
    """Log-likelihood ratios of letters: for each order, of the sequences of either class, and of the contexts for letters new to them.

    keys are the sequences of a part, ascending; totals are the classes' counts in all parts, low as in `_kneser_ney`.
    """

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, totals: np.ndarray, low: tuple[np.ndarray, np.ndarray]):
        own, each = keys, np.stack([toxic, ordinary]).astype(np.float64)
        by_class = [(own, each)]
        for order in range(ORDER - 1, SHARED - 1, -1):
            own, where = np.unique(own & _mask(order), return_inverse=True)
            each = np.stack([np.bincount(where, weights=x, minlength=len(own)) for x in each])
            by_class.insert(0, (own, each))
        # The larger class is scaled down to the other, else the smaller one's model would expect whatever is new.
        scale = np.minimum(1, totals.min() / totals)
        shared = _kneser_ney(keys, (toxic + ordinary).astype(np.float64), low=low)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backoff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order, (own, c) in enumerate(by_class, SHARED):
            context, where = np.unique(own >> _BYTE, return_inverse=True)
            c = c * scale[:, None]
            total, taken = (np.stack([np.bincount(where, weights=x, minlength=len(context)) for x in y]) for y in (c, np.minimum(c, DISCOUNT)))
            share = (taken + STRENGTH) / (total + STRENGTH)
            p = np.maximum(c - DISCOUNT, 0) / (total + STRENGTH)[:, where] + share[:, where] * shared[order][1]
            self.grams[order] = own, np.log(p[0] / p[1]).astype(np.float32)
            self.backoff[order] = context + np.uint64(1), np.log(share[0] / share[1]).astype(np.float32)

    def plain(self) -> tuple[dict, dict]:
        """What is broadcast: executors unpickle it without this package."""
        return self.grams, self.backoff

    @staticmethod
    def of(plain: tuple[dict, dict]) -> Model:
        model = Model.__new__(Model)
        model.grams, model.backoff = plain
        return model

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each letter, from the longest known sequence that ends with it or, if longer, known context of it."""
        out, left = np.zeros(len(keys), dtype=np.float32), np.arange(len(keys))
        for order in range(ORDER, SHARED - 1, -1):
            for table, back in ((self.grams[order], False), (self.backoff[order], True)):
                if not len(left):
                    return out
                own = keys[left] & _mask(order)
                # Contexts are kept one higher, as that of a word's first letter is 0.
                more, known = _get(table, (own >> _BYTE) + np.uint64(1) if back else own)
                out[left[known]] = more[known]
                left = left[~known]
        return out


def _features(words: np.ndarray) -> tuple[float, float, float]:
    """From the ratios of a text's words: ratio per word, logarithm of what passes MARGIN per word, and ratio per word of the most toxic window.

    A word that is one of the ECHO before it counts as 0, so that a word that is repeated over and over says what it says once.
    """
    if not len(words):
        return 0.0, np.log(FLOOR), 0.0
    said = words.copy()
    for lag in range(1, ECHO + 1):
        said[lag:][words[lag:] == words[:-lag]] = 0
    sums, size = np.concatenate([[0], np.cumsum(said)]), min(WINDOW, len(said))
    return said.mean(), np.log(np.maximum(said - MARGIN, 0).mean() + FLOOR), (sums[size:] - sums[:-size]).max() / WINDOW


class Parts:
    """A model's parts, each a broadcast; a worker loads one at a time and lets it go."""

    def __init__(self, shared: list):
        self.shared = shared

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        part = _part(keys, len(self.shared))
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(len(self.shared) + 1))
        out = np.zeros(len(keys), dtype=np.float32)
        for i, one in enumerate(self.shared):
            own = order[ends[i] : ends[i + 1]]
            if len(own):
                out[own] = Model.of(one.value).ratios(keys[own])
                if hasattr(one, "_path"):
                    one.__dict__.pop("_value", None)  # else the worker would keep it
        return out


def _vocabulary_ratios(words: list[bytes], model: Parts) -> np.ndarray:
    """The ratio of each word."""
    keys, first, block, size = [], [], [], 0
    for i, word in enumerate(words):
        block.append(word)
        size += len(word) + 1
        if size > 4 * CHUNK or i + 1 == len(words):
            own = _grams(b"\n".join(block))
            keys.append(own[0])
            first.append(own[1])
            block, size = [], 0
    if not keys:
        return np.zeros(0)
    return np.add.reduceat(model.ratios(np.concatenate(keys)).astype(np.float64), np.flatnonzero(np.concatenate(first)))


def _texts(column: pa.Array):
    """The texts, some at a time, so that what Python makes of a batch stays small."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


class _Group:
    """Some texts: the hashes of each one's words, and where each distinct word stands."""

    def __init__(self):
        self.docs, self.chunks, self.seen, self.size = [], [], [], 0

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        start, end, found, _ = _hashed(data, LETTERS)
        own, at = np.unique(found, return_index=True)
        self.chunks.append((data, start[at], end[at]))
        self.seen.append(own)
        self.size += len(data)
        return found, start

    def add(self, texts: list[bytes]) -> None:
        """Short texts, together."""
        base = np.cumsum([0, *(len(x) + 1 for x in texts)])
        found, start = self.hashes(b"\n".join(texts))
        bounds = np.searchsorted(start, base)
        self.docs += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def features(self, model: Parts) -> list[tuple[float, float, float]]:
        every = np.concatenate(self.seen)
        known, at = np.unique(every, return_index=True)
        chunk = np.repeat(np.arange(len(self.seen)), [len(x) for x in self.seen])[at].tolist()
        start, end = (np.concatenate([c[k] for c in self.chunks])[at].tolist() for k in (1, 2))
        ratios = _vocabulary_ratios([self.chunks[c][0][a:b] for c, a, b in zip(chunk, start, end, strict=True)], model)
        return [_features(ratios[np.searchsorted(known, own)]) for own in self.docs]


def _batched_features(texts, model: Parts) -> np.ndarray:
    """A row for each text; the words of GROUP bytes of texts are looked up together, long texts in parts of bounded size."""
    out, short, size, group = [], [], 0, _Group()

    def flush(least: int = 0):
        nonlocal group, short, size
        if short:
            group.add(short)
        short, size = [], 0
        if group.docs and group.size >= least:
            out.extend(group.features(model))
            group = _Group()

    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:
            flush(GROUP)
            group.docs.append(np.concatenate([group.hashes(part)[0] for part in _parts(data)]))
            flush(GROUP)
            continue
        short.append(data)
        size += len(data)
        if size > CHUNK:
            flush(GROUP)
    flush()
    return np.array(out).reshape(-1, 3)


def _logistic(found: DataFrame, ridge: float = 2.0) -> np.ndarray:
    """Weights of the columns a, b, c and a constant, by Newton's method; the ridge counts for columns of deviation 1. Each step sums over the rows in tasks."""
    row = found.agg(*(f(c) for f in (F.avg, F.stddev_pop) for c in "abc")).first()
    middle, spread = np.array(row[:3]), np.maximum(np.array(row[3:]), 1e-9)
    w, penalty = np.zeros(4), np.diag([ridge] * 3 + [1e-6])
    for _ in range(50):

        def sums(batches, w=w):
            for batch in batches:
                x, y = np.column_stack([batch.column(k).to_numpy() for k in range(3)]), (batch.column(3).to_numpy() > 0).astype(float)
                z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                own = np.concatenate([((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (y - p)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(20)), pa.array(own)], names=["k", "v"])

        total = np.zeros(20)
        for k, v in found.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
            total[k] = v
        step = np.linalg.solve(total[:16].reshape(4, 4) + penalty, total[16:] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / spread
    return np.round(np.append(own, w[-1] - own @ middle), 8)  # sums come in any order


#: The folds that are learned from; what is counted in each.
FOLDS = (0, 1, 3)
COUNTS = [f"{kind}_{f}" for f in FOLDS for kind in ("toxic", "ordinary")]


class Counts:
    """The sequences and their counts by fold and class, as a table; models are made from it part by part."""

    def __init__(self, grams: DataFrame, part: int = PART):
        self.grams, self.spark = cut(grams), grams.sparkSession
        self.size, *sums = self.grams.agg(F.count("*"), *(F.sum(c) for c in COUNTS)).first()
        self.totals = np.array([x or 0 for x in sums], dtype=np.float64)
        self.parts = max(1, -(-self.size // part))
        self.variants = [None, *FOLDS]
        # Continuation counts of three bytes: distinct sequences of SHARED bytes that end so. There are at most 2**24.
        seen = [F.max((sum((F.col(c) for c in COUNTS if c.rsplit("_", 1)[1] != str(v)), F.lit(0)) > 0).cast("int")).alias(f"v{i}") for i, v in enumerate(self.variants)]
        longer = self.grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("g")).agg(*seen)
        low = longer.groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * (SHARED - 1)) - 1)).alias("g")).agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(len(self.variants)))).toArrow()
        keys = low.column("g").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        self.low = keys[order], {v: low.column(f"v{i}").to_numpy()[order] for i, v in enumerate(self.variants)}

    def model(self, without: int | None = None) -> Parts | None:
        """The model of all folds but one; None if either class is missing."""
        used = [2 * i for i, f in enumerate(FOLDS) if f != without]
        totals = np.array([self.totals[used].sum(), self.totals[[k + 1 for k in used]].sum()])
        if not totals.all():
            return None
        n = self.low[1][without]
        low = _kneser_ney(self.low[0][n > 0], n[n > 0].astype(np.float64), SHARED - 1)[SHARED - 1]

        def build(part: pa.Table) -> pa.Table:
            trim()
            keys, c = part.column("gram").to_numpy().view(np.uint64), np.stack([part.column(x).to_numpy() for x in COUNTS])
            c = np.stack([c[used].sum(axis=0), c[[k + 1 for k in used]].sum(axis=0)])
            order = np.argsort(keys)
            order = order[c[:, order].any(axis=0)]
            made = Model(keys[order], *c[:, order], totals, low).plain()
            trim()
            return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

        dealt = self.grams.withColumn("part", _part_column("gram", self.parts))
        built = cut(dealt.groupBy("part").applyInArrow(build, "part int, model binary"))
        empty = {order: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)) for order in range(SHARED, ORDER + 1)}
        shared: list = [None] * self.parts
        for row in built.toLocalIterator():
            shared[row.part] = self.spark.sparkContext.broadcast(pickle.loads(row.model))
        return Parts([self.spark.sparkContext.broadcast((empty, empty)) if x is None else x for x in shared])


class Scorer:
    """The model, with the weights of the features; without a model every text gets the share of toxic labels."""

    def __init__(self, model: Parts | None, weights: np.ndarray, base: float, sequences: int = 0):
        self.model, self.weights, self.base, self.sequences = model, weights, base, sequences

    def score(self, texts) -> np.ndarray:
        if self.model is None:
            return np.full(sum(1 for _ in texts), self.base)
        return 1 / (1 + np.exp(-np.clip(_batched_features(texts, self.model) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", part: int = PART, few: int = FEW) -> Scorer:
    """Counts from the three folds; weights from each fold as the model of the other two sees it."""
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter((fold(F.col("key")) != 2) & F.col("toxic").isNotNull())
    chosen = usable.groupBy("key").agg(F.max("toxic").alias("toxic"))
    if chosen.limit(few + 1).count() <= few:
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(fold(F.col("key")) != 2).join(chosen, "key").select("text", "toxic", fold(F.col("key")).cast("int").alias("fold"))
    rows = cut(rows)

    def count(batches):
        for batch in sliced(batches):
            found: dict[str, list] = {}
            for t, y, f in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found.setdefault(f"{'toxic' if y > 0 else 'ordinary'}_{f}", []).append((t or "").lower().encode("utf-8", "surrogatepass"))
            for kind, texts in found.items():
                for a in range(0, len(texts), 256):
                    for part in _parts(b"\n".join(texts[a : a + 256]), 4 * CHUNK):
                        keys, n = np.unique(_grams(part)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(n * (kind == c)) for c in COUNTS)], names=["gram", *COUNTS])

    grams = rows.mapInArrow(count, "gram long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))
    counts = Counts(grams, part)
    found = []
    for f in FOLDS:
        if (model := counts.model(f)) is None:
            continue

        def measure(batches, model=model):
            trim()
            for batch in batches:
                x = _batched_features(_texts(batch.column(0)), model)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column(1).cast(pa.int32())], names=["a", "b", "c", "toxic"])
            trim()

        found.append(cut(rows.filter(F.col("fold") == f).mapInArrow(measure, "a double, b double, c double, toxic int")))
        for one in model.shared:
            one.destroy()
        release(docs.sparkSession)
    if found:
        found = reduce(DataFrame.unionByName, found)
        n, y = found.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
        if 0 < y < n:
            return Scorer(counts.model(), _logistic(found), 0.0, counts.size)
    share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    return Scorer(None, np.zeros(4), share)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Adds the probability that a text is toxic to all columns of docs."""
    model, weights, base = scorer.model, scorer.weights, scorer.base
    docs = without(docs, name)
    names = docs.columns
    out = docs.withColumn(name, F.lit(0.0))

    def run(batches):
        own = Scorer(model, weights, base)
        trim()
        for batch in batches:
            found = pa.array(own.score(_texts(batch.column(names.index(text)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), found], names=[*names, name])
        trim()

    return docs.mapInArrow(run, out.schema)


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the texts whose score reaches the threshold."""
    name = private(docs, "__toxicity")
    scored = score(docs, learn(docs, labels, key, text), text, name)
    return scored.filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
