"""Repeated passages by blockwise suffix sorting with ranked cover samples.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Copies are settled first: of
equal texts only the one of smallest id takes part; in the others everything goes (a text shorter than LENGTH stays).

1. Cover sample. Of each document the positions p with p mod PERIOD in COVER, a difference cover, are sampled. Any two positions have a shift below PERIOD
   that brings both into the sample, so two equal strings of LENGTH bytes hold two sampled suffixes that agree for
   BLOCK = LENGTH - PERIOD + 1 bytes. The codes of these are sorted bucket by bucket, and those that two texts have are known from then on. A code
   that several texts of one batch have goes to its bucket once, so a frequent passage leaves a row a batch there.
2. Suffixes that can repeat: those whose first LENGTH bytes hold a repeated sample. Suffixes of texts that share nothing never leave their
   document. A kept suffix belongs to the bucket of its anchor, the block of least hash within its first LENGTH bytes (the first of equals): equal
   strings have equal anchors at the same shift below PERIOD, as the cover has for each two suffixes but as one sort key for all. Neighbours mostly share an
   anchor, so runs of them travel as one piece of text. Equal runs that meet in a task travel once.
3. One bucket is sorted at a time, or some small ones together. Its anchors are ranked first: by the bytes behind them, and by those before them, read
   backwards, each with the common prefix of neighbours, which gives the rank for every depth. A suffix at shift t is then ordered by its first t bytes
   and its anchor's rank to the depth that is left, both known numbers, so that no string is compared twice and long ties cost nothing. Neighbours
   that agree in both are equal strings; those of later documents are reported.

A bucket of more than HOT_BUCKET runs is split: each of its suffixes becomes a bucket of its own, by the hash of its LENGTH bytes. Of one string each
task sends one run.

Null texts are empty. Rows that share an id are not compared with each other, rows without an id with nothing; both keep a row each. Very long
texts are read whole, in parts. Extra columns are ignored by `remove_repeats`' result, which has one row for each row of the table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_counted, mix, powers, prefix_hash, sliced, stored, trim

LENGTH, PERIOD = 50, 31
#: A perfect difference cover of the period: every number below 31 is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
BLOCK = LENGTH - PERIOD + 1
#: Bits of a code beyond those that number all samples; samples that agree in them by chance cost time only.
SPARE_BITS = 11
#: Samples in a bucket.
BUCKET = 1_500_000
#: Bytes of text that are looked at together; at most 2 ** 20, as places take 21 bits.
PART = 1 << 20
#: Runs that a task holds before it passes them on, or sorts them if a bucket ends there; runs from which a bucket is split; split buckets that are broadcast.
AT_ONCE, HOT_BUCKET, FEW = 100_000, 200_000, 1_000_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _samples(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's cover sample, and their hashes."""
    at, hashes = [], []
    for low in range(0, max(1, len(data) - BLOCK + 1), PART):
        part = data[low : low + PART + BLOCK - 1]
        own = _cover_places(low % PERIOD, len(part) - BLOCK + 1)
        at.append(own + low)
        hashes.append(_hashes_at(part, own))
    return np.concatenate(at), np.concatenate(hashes)


def _hashes_at(data: bytes, at: np.ndarray) -> np.ndarray:
    buf = np.frombuffer(data, dtype=np.uint8)
    c, (_, down) = prefix_hash(buf), powers(len(buf))
    return mix((c[at + BLOCK] - c[at]) * down[at])


_places: list[np.ndarray] = [np.flatnonzero(_IN_COVER)]


def _cover_places(phase: int, n: int) -> np.ndarray:
    """The places below n that are sampled, if the first one is at `phase` of the period."""
    while _places[0][-1] < n + PERIOD:
        size = 2 * (int(_places[0][-1]) // PERIOD + 1) * PERIOD
        _places[0] = np.flatnonzero(np.resize(_IN_COVER, size))
    low, high = np.searchsorted(_places[0], [phase, phase + max(n, 0)])
    return _places[0][low:high] - phase


def _many_samples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of the samples of texts, hashed together up to PART bytes at a time; longer ones alone."""
    numbers, hashes, group, base, size = [], [], [], [], 0

    def flush():
        nonlocal size
        if group:
            hashes.append(_hashes_at(b"".join(group), np.concatenate(base)))
            group.clear(), base.clear()
            size = 0

    for i, t in enumerate(texts):
        if len(t) > PART:
            flush()
            h = _samples(t)[1]
            hashes.append(h)
            numbers.append(np.full(len(h), i, dtype=np.uint16))
            continue
        own = _cover_places(0, len(t) - BLOCK + 1) if len(t) >= LENGTH else _places[0][:0]
        numbers.append(np.full(len(own), i, dtype=np.uint16))
        group.append(t)
        base.append(own + size)
        size += len(t)
        if size >= PART:
            flush()
    flush()
    if not numbers:
        return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint64)
    return np.concatenate(numbers), np.concatenate(hashes)


def _repeated_samples(texts: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(digest, codes), and the bits of a code: for each text, by its digest, the low 32 bits of the sample codes that another text has too."""
    samples = max(1, total * len(COVER) // PERIOD)
    bits = min(56, math.ceil(math.log2(samples + 1)) + SPARE_BITS)
    number_bits = min(12, 63 - bits)
    bucket_bits = max(0, math.ceil(math.log2(samples / BUCKET))) if samples > BUCKET else 0

    buckets = 1 << bucket_bits

    def pack(batches):
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in sliced(batches, 1 << number_bits):
            digests = batch.column(0).to_numpy()
            for a in range(0, len(digests), 1 << number_bits):
                own = digests[a : a + (1 << number_bits)]
                numbers, both = _many_samples(batch.column(1).slice(a, 1 << number_bits).to_pylist())
                both >>= np.uint64(64 - bits)
                both <<= np.uint64(number_bits)
                both |= numbers
                both.sort()
                both = both[np.diff(both, prepend=both[:1] - np.uint64(1)) > 0]
                codes, numbers = both >> np.uint64(number_bits), (both & np.uint64((1 << number_bits) - 1)).astype(np.uint16)
                # What two texts have here is known already: a reply for each of them, dealt by the text, and one of them for the code's bucket.
                new = np.diff(codes, prepend=codes[:1] - np.uint64(1)) > 0
                times = np.diff(np.append(np.flatnonzero(new), len(codes)))
                several = np.repeat(times > 1, times)
                rows = []
                order = np.flatnonzero(several)[np.argsort(numbers[several], kind="stable")]
                start = np.flatnonzero(np.diff(numbers[order].astype(np.int32), prepend=-1))
                for x, y in zip(start, np.append(start[1:], len(order)), strict=True):
                    digest = own[numbers[order[x]]]
                    rows.append((buckets + int(digest) % buckets, 0, 0, codes[order[x:y]].astype(np.uint32).tobytes(), b"", digest.tobytes()))
                codes, numbers = codes[new], numbers[new]
                bucket = (codes >> np.uint64(bits - bucket_bits)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in range(buckets):
                    c = codes[edges[b] : edges[b + 1]]
                    if len(c):
                        gaps = np.diff(c, prepend=c[:1])
                        width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                        packed = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                        used, n = np.unique(numbers[edges[b] : edges[b + 1]], return_inverse=True)
                        rows.append((b, int(c[0]), width, packed, n.astype(np.uint16).tobytes(), own[used].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "first", "width", "gaps", "numbers", "digests"])

    packs = texts.mapInArrow(pack, "bucket int, first long, width int, gaps binary, numbers binary, digests binary")

    def sort_bucket(group: pa.Table) -> pa.Table:
        trim()
        if group.column("width")[0].as_py() == 0:  # replies
            return pa.table({"digest": pa.array([int.from_bytes(d, "little", signed=True) for d in group.column("digests").to_pylist()], pa.int64()), "codes": group.column("gaps")})
        codes, owners = [], []
        for first, width, gaps, numbers, digests in zip(*(group.column(c).to_pylist() for c in ("first", "width", "gaps", "numbers", "digests")), strict=True):
            wide = np.zeros((len(gaps) // width, 8), dtype=np.uint8)
            wide[:, :width] = np.frombuffer(gaps, dtype=np.uint8).reshape(-1, width)
            codes.append(np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(first))
            owners.append(np.frombuffer(digests, dtype=np.int64)[np.frombuffer(numbers, dtype=np.uint16)])
        code, owner = np.concatenate(codes), np.concatenate(owners)
        # Only codes that occur twice can be those of two texts.
        ordered = np.sort(code)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.searchsorted(twice, code)
        some = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == code) if len(twice) else at[:0]
        code, owner, at = code[some], owner[some], at[some]
        low, high = np.full(len(twice), np.iinfo(np.int64).max), np.full(len(twice), np.iinfo(np.int64).min)
        np.minimum.at(low, at, owner)
        np.maximum.at(high, at, owner)
        shared = (low < high)[at]
        code, owner = code[shared], owner[shared]
        order = np.argsort(owner)
        code, owner = code[order].astype(np.uint32), owner[order]
        start = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1)) if len(owner) else np.zeros(0, dtype=np.int64)
        ends = np.append(start[1:], len(owner)) if len(owner) else start
        return pa.table({"digest": pa.array(owner[start]), "codes": pa.array([np.unique(code[a:b]).tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())})

    found = packs.groupBy("bucket").applyInArrow(sort_bucket, "digest long, codes binary")
    return found.groupBy("digest").agg(F.collect_list("codes").alias("codes")), bits


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Runs:
    """Suffixes that can repeat, as runs that share an anchor: where each starts in its text, how far its anchor is from there, its size, and two hashes of its piece."""

    def __init__(self, texts: list[bytes], places: list[tuple[int, int]], known: list[np.ndarray], bits: int):
        """places: the number of each text's document and its offset in it. known: the codes of repeated samples of the texts, sorted."""
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        c, (_, down) = prefix_hash(buf), powers(len(buf))
        blocks = len(buf) - BLOCK + 1
        h = mix((c[BLOCK:] - c[:-BLOCK]) * down[:blocks])
        # Suffixes that hold a repeated sample.
        own = [_cover_places(off % PERIOD, len(t) - BLOCK + 1) + s for t, (_, off), s in zip(texts, places, starts.tolist(), strict=True)]
        which = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(x) for x in own])
        at = np.concatenate(own)
        codes = (h[at] >> np.uint64(64 - bits)).astype(np.uint32).astype(np.uint64)
        listed = np.concatenate([np.unique(k).astype(np.uint64) | np.uint64(i << 32) for i, k in enumerate(known)])
        hit = np.searchsorted(listed, codes | (which << np.uint64(32)))
        some = listed[np.minimum(hit, len(listed) - 1)] == codes | (which << np.uint64(32)) if len(listed) else np.zeros(len(at), dtype=bool)
        at, which = at[some], which[some].astype(np.int64)
        low, high = np.maximum(at - PERIOD + 1, starts[which]), np.minimum(at, ends[which] - LENGTH)
        right = low <= high
        edge = np.bincount(low[right], minlength=len(buf) + 2) - np.bincount(high[right] + 1, minlength=len(buf) + 2)
        wanted = np.cumsum(edge[:blocks]) > 0
        # Anchors: the least hash among the PERIOD blocks of each string, the first of equals; by minima from both sides of stretches of PERIOD.
        value = (h & ~np.uint64((1 << 21) - 1)) | np.arange(blocks, dtype=np.uint64)
        padded = np.concatenate([value, np.full(-blocks % PERIOD + PERIOD, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, PERIOD)
        left = np.minimum.accumulate(padded, axis=1).reshape(-1)
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(back[:blocks], left[PERIOD - 1 : PERIOD - 1 + blocks]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        changed = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = np.flatnonzero(wanted & (changed | np.concatenate([[True], ~wanted[:-1]])))
        last = np.flatnonzero(wanted & np.concatenate([changed[1:] | ~wanted[1:], [True]]))
        text = np.searchsorted(ends, first, side="right")
        stop = last + LENGTH
        self.code = h[anchor[first]].view(np.int64)
        self.doc = np.array([d for d, _ in places], dtype=np.int64)[text]
        self.at = first - starts[text] + np.array([off for _, off in places], dtype=np.int64)[text]
        self.head = anchor[first] - first
        self.size = stop - first
        self.one = mix((c[stop] - c[first]) * down[first] + (self.size * 64 + self.head).astype(np.uint64))
        other = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(mix(buf.astype(np.uint64) + np.uint64(0x9E37)) * powers(len(buf))[0][: len(buf)], out=other[1:])
        self.two = mix((other[stop] - other[first]) * down[first])
        self.piece = _cut_out(buf, first, self.size)


def _cut_out(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of a buffer, as an array of binaries."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binaries without nulls, and where each begins and ends."""
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8), offsets


def _order(keys: pa.Array) -> np.ndarray:
    """A number for each key, in the keys' order; equal keys have the same."""
    named = keys.dictionary_encode()
    place = np.empty(len(named.dictionary), dtype=np.int64)
    place[pc.array_sort_indices(named.dictionary).to_numpy()] = np.arange(len(named.dictionary))
    return place[named.indices.to_numpy()]


def _spans_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping spans of a document as one: (doc, start, end)."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + doc * far)
    new = np.concatenate([[True], (start + doc * far)[1:] > reach[:-1]]) if len(doc) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return doc[at], start[at], (reach[np.append(at[1:], len(doc)) - 1] - doc[at] * far) if len(at) else end[:0]


_RUN = ["code", "key", "digest", "ats", "head", "size", "piece"]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _once(keys: pa.Array, digests: np.ndarray, rows: np.ndarray, code: np.ndarray, at: np.ndarray, head: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, piece: pa.Array):
    """Of equal runs the first document's, with its places in it; those of later documents are known to repeat, and are spans dealt by their text.

    rows: the place of each run's document in keys and digests.
    """
    who = _order(keys)[rows]
    order = np.lexsort((at, digests[rows], who, two, one))
    a, b, w, d = one[order], two[order], who[order], digests[rows][order]
    piece_new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    own_new = piece_new | np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])
    least = w[np.flatnonzero(piece_new)][np.cumsum(piece_new) - 1]
    known = w != least
    kept, first = order[~known], own_new[~known]
    at_first = kept[first]
    counts = np.diff(np.append(np.flatnonzero(first), len(kept)))
    yield pa.RecordBatch.from_arrays([pa.array(code[at_first]), keys.take(pa.array(rows[at_first])), pa.array(digests[rows[at_first]]), _lists(at[kept], counts), pa.array(head[at_first].astype(np.int32)), pa.array(size[at_first].astype(np.int32)), piece.take(pa.array(at_first))], names=_RUN)
    if known.any():
        doc, start, end = _spans_of(rows[order[known]], at[order[known]], (at + size)[order[known]])
        none = pa.nulls(len(doc), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(digests[doc]), keys.take(pa.array(doc)), pa.array(digests[doc]), _lists(start, np.ones(len(doc), dtype=np.int64)), pa.array(np.zeros(len(doc), dtype=np.int32)), pa.array((end - start).astype(np.int32)), none], names=_RUN)


def _emit(bits: int, at_once: int):
    """(key, digest, data, codes) to runs."""

    def run(batches):
        trim()
        held, keys, digests = [], [], []

        def flush():
            if held:
                own = pa.concat_arrays(keys)
                yield from _once(own, np.concatenate(digests), np.concatenate([r.doc for r in held]), *(np.concatenate([getattr(r, c) for r in held]) for c in ("code", "at", "head", "size", "one", "two")), pa.concat_arrays([r.piece for r in held]))
            held.clear(), keys.clear(), digests.clear()

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                base = sum(map(len, keys))
                keys.append(part.column("key"))
                digests.append(_ints(part.column("digest")))
                texts, places, known, size = [], [], [], 0
                for i, (data, codes) in enumerate(zip(part.column("data").to_pylist(), part.column("codes").to_pylist(), strict=True)):
                    own = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in codes])
                    for off in range(0, len(data) - LENGTH + 1, PART // 2):
                        piece = data[off : off + PART // 2 + LENGTH - 1]
                        texts.append(piece)
                        places.append((base + i, off))
                        known.append(own)
                        size += len(piece)
                        if size >= PART // 2:
                            held.append(_Runs(texts, places, known, bits))
                            texts, places, known, size = [], [], [], 0
                if texts:
                    held.append(_Runs(texts, places, known, bits))
                if sum(len(r.code) for r in held) > at_once:
                    yield from flush()
        yield from flush()
        trim()

    return run


def _split(batches):
    """Runs of a hot bucket to runs of one suffix each, in buckets by the suffix's hash."""
    trim()
    for batch in batches:
        for low in range(0, batch.num_rows, 8192):
            part = batch.slice(low, 8192)
            buf, offsets = _bytes(part.column("piece"))
            n = np.diff(offsets) - LENGTH + 1
            row = np.repeat(np.arange(len(n)), n)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = offsets[row] + shift
            c, (_, down) = prefix_hash(buf[: offsets[-1]]), powers(int(offsets[-1]))
            one = mix((c[first + LENGTH] - c[first]) * down[first])
            words = [_word(buf, first + k) for k in (0, 8, 16, 24, 32, 40, 42)]
            two = np.zeros(len(first), dtype=np.uint64)
            for w in words:
                two = mix(two ^ w)
            ats = part.column("ats")
            counts = np.diff(_ints(ats.offsets))
            every = _ints(ats.flatten())
            # Each occurrence of a run in its document is a row here.
            times = counts[row]
            pick = np.repeat(np.arange(len(row)), times)
            place = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            at = every[(np.cumsum(counts) - counts)[row[pick]] + place] + shift[pick]
            head = _ints(part.column("head")).astype(np.int64)[row[pick]] - shift[pick]
            yield from _once(part.column("key"), _ints(part.column("digest")), row[pick], one[pick].view(np.int64) ^ 1, at, head, np.full(len(pick), LENGTH), one[pick], two[pick], _cut_out(buf, first[pick], np.full(len(pick), LENGTH)))


def _word(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts as they do."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | buf[at + k].astype(np.uint64)
    return out


def _ranked(bucket: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows sorted by bucket and context (a row of bytes each), and how many bytes neighbours share; -1 between buckets."""
    words = np.ascontiguousarray(np.pad(context, ((0, 0), (0, -context.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], bucket))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    ordered, of = context[order], bucket[order]
    unlike = ordered[1:] != ordered[:-1]
    same = np.where(unlike.any(axis=1), unlike.argmax(axis=1), context.shape[1])
    same[of[1:] != of[:-1]] = -1
    return place, np.concatenate([[-1], same])


def suffix_classes(bucket: np.ndarray, buf: np.ndarray, first: np.ndarray, head: np.ndarray, size: np.ndarray):
    """The sorted suffixes of some buckets: for each shift t of the anchor, the runs that have a suffix there, in order, and which of them begin another string.

    Runs: bucket, first byte in buf, anchor's distance from it, and size. By t: (t, runs, new), runs of equal strings in their given order.
    """
    reach = np.arange(PERIOD - 1)
    padded = np.concatenate([np.zeros(PERIOD, dtype=np.uint8), buf, np.zeros(PERIOD, dtype=np.uint8)])
    anchor = first + head
    before = padded[np.maximum(anchor[:, None] - 1 - reach, first[:, None] - 1) + PERIOD]
    before[reach >= head[:, None]] = 0
    spare = (size - head - BLOCK)[:, None]
    after = padded[np.minimum(anchor[:, None] + BLOCK + reach, (first + size)[:, None]) + PERIOD]
    after[reach >= spare] = 0
    (left, left_same), (right, right_same) = _ranked(bucket, before), _ranked(bucket, after)
    least = head - (size - LENGTH)
    for t in range(PERIOD):
        runs = np.flatnonzero((least <= t) & (t <= head))
        if not len(runs):
            continue
        key = np.cumsum(left_same < t)[left[runs]] * (len(bucket) + 1) + np.cumsum(right_same < PERIOD - 1 - t)[right[runs]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        yield t, runs[order], np.concatenate([[True], key[1:] != key[:-1]])


def _repeats(bucket: np.ndarray, who: np.ndarray, pieces: pa.Array, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end in it) of strings that an earlier document has too; runs of a bucket come in their documents' order."""
    buf, offsets = _bytes(pieces)
    size = np.diff(offsets)
    found_run, found_at = [], []
    for t, runs, new in suffix_classes(bucket, buf, offsets[:-1], head, size):
        first = runs[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = runs[who[runs] != who[first]]
        found_run.append(hit)
        found_at.append(head[hit] - t)
    run, at = np.concatenate(found_run), np.concatenate(found_at)
    return _spans_of(run, at, at + LENGTH)


def _compare(at_once: int):
    """Runs sorted by bucket and document to spans (key, digest, start, end)."""

    def spans(keys, digests, ats, run, start, end):
        counts, every = np.diff(_ints(ats.offsets)), _ints(ats.flatten())
        times = counts[run]
        pick = np.repeat(np.arange(len(run)), times)
        place = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
        base = every[(np.cumsum(counts) - counts)[run[pick]] + place]
        rows = pa.array(run[pick])
        return pa.RecordBatch.from_arrays([keys.take(rows), digests.take(rows), pa.array(base + start[pick]), pa.array(base + end[pick])], names=["key", "digest", "start", "end"])

    def sort(table: pa.RecordBatch):
        code, keys = _ints(table.column("code")), table.column("key")
        bucket = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))
        found = _repeats(bucket, _order(keys), table.column("piece"), _ints(table.column("head")).astype(np.int64))
        if len(found[0]):
            yield spans(keys, table.column("digest"), table.column("ats"), *found)

    def run(batches):
        trim()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            plain = pc.is_null(batch.column("piece"))
            known = batch.filter(plain)
            if known.num_rows:
                n = np.arange(known.num_rows)
                yield spans(known.column("key"), known.column("digest"), known.column("ats"), n, np.zeros(len(n), dtype=np.int64), _ints(known.column("size")).astype(np.int64))
            rest = batch.filter(pc.invert(plain))
            for low in range(0, rest.num_rows, at_once):
                held.append(rest.slice(low, at_once))
                if sum(b.num_rows for b in held) >= at_once:  # up to where the last bucket begins
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    code = _ints(whole.column("code"))
                    end = int(np.searchsorted(code, code[-1]))
                    if end:
                        yield from sort(pa.Table.from_batches([whole.slice(0, end)]).combine_chunks().to_batches()[0])
                    held = [whole.slice(end)]
        if sum(b.num_rows for b in held):
            yield from sort(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        trim()

    return run


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(data: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


_SPANS = "array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", at_once: int = AT_ONCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans are the removed byte spans of the UTF-8 text."""
    kind = docs.schema[key].dataType.simpleString()
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(key).alias("key"), data.alias("data"))
    base = base.withColumns({"digest": F.xxhash64("data"), "other": F.xxhash64(F.lit(1), "data"), "n": F.octet_length("data").cast("long")})
    narrow = cut(base.select("key", "digest", "other", "n", F.when((F.col("n") < LENGTH) | F.col("key").isNull(), F.sha2("data", 256)).alias("sha")))
    same = ["digest", "other", "n"]
    classes = cut(narrow.filter("key IS NOT NULL").groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("rows")))
    total = classes.agg(F.sum("n")).first()[0] or 0

    long_ = base.filter((F.col("n") >= LENGTH) & F.col("key").isNotNull())
    reps = classes.filter(F.col("n") >= LENGTH).select(F.col("rep").alias("key"), "digest")
    replies, bits = _repeated_samples(long_.select("key", "digest", "data").join(reps, ["key", "digest"]).select("digest", "data"), total)
    replies = cut(replies)

    flagged = long_.select("key", "digest", "data").join(reps.join(replies, "digest"), ["key", "digest"])
    kinds = f"code long, key {kind}, digest long, ats array<long>, head int, size int, piece binary"
    runs, folder = stored(flagged.select("key", "digest", "data", "codes").mapInArrow(_emit(bits, at_once), kinds))
    hot = cut(runs.filter("piece IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > hot_bucket).select("code"))
    hot = F.broadcast(hot) if (n := hot.count()) <= FEW else hot
    if n:
        cold = runs.join(hot, "code", "left_anti").unionByName(runs.filter("piece IS NULL").join(hot, "code", "left_semi"))
        runs = cold.unionByName(runs.filter("piece IS NOT NULL").join(hot, "code", "left_semi").select(*_RUN).mapInArrow(_split, kinds))
    hits = runs.repartition("code").sortWithinPartitions("code", "key").mapInArrow(_compare(at_once), f"key {kind}, digest long, start long, end long")
    spans = cut(hits.groupBy("key", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    discard(docs.sparkSession, folder)
    first = long_.select("key", "digest", "n", "data").join(reps.join(spans, ["key", "digest"], "left"), ["key", "digest"])

    def finish(batches):
        for batch in batches:
            keys, sizes, texts, found = (batch.column(c) for c in ("key", "n", "data", "spans"))
            merged = [_merge((s["start"], s["end"]) for s in f or ()) for f in found.to_pylist()]
            shas = [hashlib.sha256(_without(d, m)).hexdigest() for d, m in zip(texts.to_pylist(), merged, strict=True)]
            kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([keys, sizes, pa.array(shas, pa.string()), pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], kind_)], names=["key", "n", "sha", "spans"])

    none = F.array().cast(_SPANS)
    first = first.select("key", "n", "data", "spans").mapInArrow(finish, f"key {kind}, n long, sha string, spans {_SPANS}")

    rows = classes.agg(F.sum("rows")).first()[0] or 0
    copies = join_counted(narrow.filter("key IS NOT NULL"), classes, same, "rows", rows).filter((F.col("key") != F.col("rep")) | (F.col("n") < LENGTH))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    gone = (F.col("n") >= LENGTH) & F.col("key").isNotNull()
    rest = copies.select("key", "n", "sha").unionByName(narrow.filter("key IS NULL").select("key", "n", "sha"))
    rest = rest.select("key", "n", F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("sha"), F.when(gone, everything).otherwise(none).alias("spans"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return first.unionByName(rest).select(F.col("key").alias(key), F.col("n").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), "spans")
