"""Language by the nearest centroid: TF-IDF vectors of letter n-grams against several clustered centroids of each language, by cosine.

Letters are lower-cased; all else becomes one space. 1- to 3-grams are hashed to DIMENSIONS counters, which are damped by
a logarithm, weighted by inverse document frequency and normalised. Each language's sample is clustered into
CENTROIDS by spherical k-means. A text gets the language of the centroid of greatest cosine; `rejected` marks those farther from
it than all but REJECT of the sample were from theirs.

Bound: PER_LANGUAGE documents of each language are learned from, those of the least hashes of the id, outside fold 2; all
languages of the table are learned. Null texts, and texts without a letter, are 'und' with score 0. Whole texts are read, in parts of
bounded memory. Rows without a language are not learned from. If nothing was learned, every text is 'und'. Extra columns
pass through; columns named as those that are added are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, sliced, without

DIMENSIONS, CENTROIDS, PER_LANGUAGE, ROUNDS, REJECT = 1 << 13, 3, 300, 12, 0.005
UNKNOWN = "und"
PART = 1 << 18
_BITS = np.uint64(64 - 13)
_BY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _letters(text: str) -> np.ndarray:
    """Code points of a part of a lower-cased text; each run of other characters is one space."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = ((chars >= 97) & (chars <= 122)) | (chars >= 0xAA) & (chars != 0xB7) & (chars != 0xD7) & (chars != 0xF7)
    far = np.flatnonzero(chars > 0xFF)
    if len(far):
        kinds, where = np.unique(chars[far], return_inverse=True)
        plain[far] = np.array([chr(c).isalpha() for c in kinds.tolist()])[where]
    low = np.flatnonzero((chars > 0x7F) & (chars <= 0xFF))
    if len(low):
        plain[low] = np.array([chr(c).isalpha() for c in range(256)])[chars[low]]
    own = np.where(plain, chars, np.uint32(32))
    keep = np.ones(len(own), dtype=bool)
    keep[1:] = plain[1:] | plain[:-1]
    return own[keep].astype(np.uint64)


def counts(text: str | None) -> np.ndarray | None:
    """How often each counter's n-grams occur, with a space before and after the text; None without a letter.

    A long text is read in parts; the two characters before a part go with it, so that no n-gram is lost or added at its edge.
    """
    total, some, before, text = np.zeros(DIMENSIONS), False, np.zeros(0, dtype=np.uint64), f" {(text or '').lower()} "
    for at in range(0, len(text), PART):
        own = _letters(text[at : at + PART])
        some |= bool((own != 32).any())
        if len(before) and before[-1] == own[0] == 32:
            own = own[1:]
        c = np.concatenate([before, own])
        h, new = c * _BY[0], len(before)
        for n in range(1, 4):
            # h[i] is of the n characters from i; those that end in this part are counted.
            fresh = h[max(0, new - n + 1) :]
            total += np.bincount(((fresh ^ (fresh >> np.uint64(29))) * _BY[1] >> _BITS).astype(np.int64), minlength=DIMENSIONS)
            if n < 3:
                h = h[:-1] * _BY[2] + c[n:] * _BY[0]
        before = c[-2:]
    return total if some else None


def _vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart beginnings; fewer centroids if there are fewer vectors."""
    chosen = [int((vectors @ vectors.sum(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


class Languages:
    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray, least: float):
        self.idf, self.names, self.centres, self.least = idf, names, centres, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0, True
        cosines = self.centres @ _vector(found, self.idf)
        best = int(cosines.argmax())
        return self.names[best], float(min(max(cosines[best], 0.0), 1.0)), bool(cosines[best] < self.least)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS):
    """A broadcast of what `Languages` is made of; some hundred kB a language."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang")).filter((fold(F.col("key")) != 2) & F.col("lang").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = labelled.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= per_language).select("key", "lang")
    # So many rows for each language: small enough to be sent to all.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter((fold(F.col("key")) != 2) & F.col("lang").isNotNull()).join(F.broadcast(chosen), ["key", "lang"])

    def count(batches):
        for batch in batches:
            kept = [(lang_, c) for lang_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := counts(t)) is not None]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept]), pa.array([c.astype(np.float32).tobytes() for _, c in kept], pa.binary())], names=["lang", "found"])

    sample = rows.select("lang", "text").mapInArrow(count, "lang string, found binary").persist()

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, dtype=np.float32) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "found"])

    n, seen = 0, np.zeros(DIMENSIONS)
    for row in sample.mapInArrow(frequencies, "n long, found binary").toLocalIterator():
        n, seen = n + row.n, seen + np.frombuffer(row.found)
    idf = np.log((n + 1) / (seen + 1)) + 0.1

    def cluster(group):
        vectors = np.stack([_vector(np.frombuffer(x, dtype=np.float32), idf) for x in group.column("found").to_pylist()])
        centres = _cluster(vectors, centroids)
        near = (vectors @ centres.T).max(axis=1)
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres], "least": [float(np.quantile(near, REJECT))] * len(centres)})

    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, centre binary, least double").orderBy("lang", "centre").collect()
    sample.unpersist()
    centres = np.stack([np.frombuffer(r.centre, dtype=np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return spark.sparkContext.broadcast({"idf": idf, "names": [r.lang for r in found], "centres": centres, "least": min([r.least for r in found], default=0.0)})


def identify(docs: DataFrame, languages, text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected to all columns of docs."""
    docs = without(docs, "lang_pred", "lang_score", "lang_rejected")
    names = docs.columns
    out = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)})

    def run(batches):
        known = Languages(**languages.value)
        for batch in sliced(batches):
            found = [known.predict(t) for t in batch.column(names.index(text)).to_pylist()]
            own = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *own], names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(run, out.schema)
