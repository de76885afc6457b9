"""Each operator against a plain version of its contract, on texts with copies, edits, shared passages, nulls and odd characters."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sealyard.llm import decontam, hyperminhash, langid, mixing, pii, quotes, sharding, suffixes, topk, toxicity
from sealyard.llm import common as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "é", "Ru", "t", "üx"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    texts = []
    for i in range(n):
        w = [word() for _ in range(rnd.choice([0, 1, 2, 5, 40, 300]))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split(" ")
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
        if i % 4 == 0 and texts:
            base = rnd.choice(texts).split(" ")
            for _ in range(rnd.choice([0, 1, 2])):
                base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += [None, "", " \t\n ", "🙂 odd ﬁ text", "x" * 300, "x" * 300 + " y", "a b c " * 3000, texts[0], texts[0]]
    rows = [(k, t, None if t is None else ["en", "de"][k % 2], None if k % 7 == 0 else f"s{k % 4 if k % 3 else 0}", None) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


# ---------------------------------------------------------------- helpers


def test_word_hashes_tell_words_apart():
    texts = ["Ab ab  c", None, "", "ab\tc\nab", "x" * 10, "é É e"]
    for table, pattern in ((C.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (C.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = [(int(p.doc[i]) + p.first, int(p.hashes[i])) for p in C.words_of(texts, table) for i in range(len(p.hashes))]
        want = [(d, w) for d, t in enumerate(texts) for w in words(t, pattern)]
        assert [d for d, _ in got] == [d for d, _ in want]
        assert len({h for _, h in got}) == len({w for _, w in want}) and len({(h, w) for (_, h), (_, w) in zip(got, want, strict=True)}) == len({w for _, w in want})


def test_long_text_in_parts(monkeypatch):
    text = "one two three " * 400
    whole = [p.hashes.tolist() for p in C.words_of([text], C.NOT_SPACE)]
    monkeypatch.setattr(C, "CHUNK", 100)
    assert [p.hashes.tolist() for p in C.words_of([text], C.NOT_SPACE)] == whole


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    for small in (C.SMALL, 10):
        got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long").repartition(3), small).collect()}
        assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    named = C.components(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string"))
    assert {r.node: r.component for r in named.collect()} == {f"n{x:03}": f"n{y:03}" for x, y in got.items()}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1: personal data


@pytest.mark.parametrize(
    "text,found",
    [
        ("mail john.doe (at) example (dot) com now", ["email:john.doe (at) example (dot) com"]),
        ("john at example dot com", ["email:john at example dot com"]),
        ("ｊohn＠example．com", ["email:ｊohn＠example．com"]),
        ("jоhn@exаmple.com", ["email:jоhn@exаmple.com"]),  # Cyrillic letters
        ("a​b@x​.com", ["email:a​b@x​.com"]),
        ("plus one nine eight zero five five five six two six eight", ["phone:plus one nine eight zero five five five six two six eight"]),
        ("+1 980 five five five six two six eight", ["phone:+1 980 five five five six two six eight"]),
        ("４８４５１６８１１４４０７３２９", ["card:４８４５１６８１１４４０７３２９"]),
        ("one two seven dot zero dot zero dot one", ["ip:one two seven dot zero dot zero dot one"]),
        ("card 4845 l68l 1440 7329 now", ["card:4845 l68l 1440 7329"]),
        ("from l92.168.0.1 on", []),
        ("call +l 980 555 6268O", ["phone:+l 980 555 6268O"]),
        ("jane AT mail7.example.com", ["email:jane AT mail7.example.com"]),
        ("ana arroba correo.example.es", ["email:ana arroba correo.example.es"]),
        ("all 12 oil 5 Io lol 10", []),
        ("look at that point. One or two", []),
        ("er at 12.5 and at www.example.com/x", []),
        ("uno dos tres", []),
        ("", []),
    ],
)
def test_disguises(text, found):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.disguised(text, pii.spans(text), *pii.hints([text])[0])] == found


def test_plain_spans_match_the_patterns():
    rnd = random.Random(3)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4845 1681-1440 7329", "+1 (980) 555-6268", " ", "9", "x@y", "0001.2.3.4.5", "a@b.c@d.e", "+", "-", "é"]
    P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]

    for _ in range(3000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))
        want = [(k, *m.span()) for k, p in P.items() for m in re.finditer(p, t) if ok(k, m[0])]
        assert pii.spans(t) == want
        assert all(k[0] in P for k in pii.disguised(t, want))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to a@b.c or to x (at) y (dot) zz.", "p"), (2, None, "p")], "doc_id long, text string, pii_plain string")
    assert [r.text for r in pii.redact(df.drop("pii_plain")).orderBy("doc_id").collect()] == ["write to [email] or to [email].", None]


# ---------------------------------------------------------------- 2 and 8: shards, mixes


def test_growing_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(16)
    got = df.select("doc_id", sharding.leaf(F.col("doc_id"), tree).alias("a"), sharding.leaf(F.col("doc_id"), sharding.with_shard(tree, 16)).alias("b")).collect()
    assert all(r.a == r.b or r.b == 16 for r in got) and {r.a for r in got} == set(range(16))
    sizes = Counter(r.b for r in got)
    assert len(sizes) == 17 and all(150 < n < 330 for n in sizes.values())


def test_a_heavier_rack_takes_rows_from_its_region_only_inside(spark):
    tree = {"a": {"r": {0: 1, 1: 1}, "s": {2: 2}}, "b": {"r": {3: 4}}}
    heavier = {"a": {"r": {0: 1, 1: 1}, "s": {2: 2}}, "b": {"r": {3: 4}, "s": {4: 4}}}
    got = spark.range(3000).select(sharding.leaf(F.col("id"), tree).alias("a"), sharding.leaf(F.col("id"), heavier).alias("b")).collect()
    assert all(r.a == r.b or r.b in (3, 4) for r in got)


def test_slots_have_no_gap(spark, docs):
    got = sharding.with_slots(sharding.assign_shards(docs, "doc_id", sharding.even_tree(5)), "doc_id", ["doc_id"], buckets=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())


def filled(sizes):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        if not open_:
            return fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, docs, rows, monkeypatch):
    got = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = filled(sizes)
    for r in got:
        assert r.mix_size == len(words(r.text)) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source]) and 0 <= r.mix_copies <= 3
    taken = Counter()
    for r in got:
        taken[r.source] += r.mix_size * r.mix_copies
    for s in sizes:
        part = want[s] / sizes[s] % 1
        spread = sum(part * (1 - part) * len(words(t)) ** 2 for _, t, _, x, _ in rows if x == s) ** 0.5
        assert abs(taken[s] - want[s]) <= 4 * spread
    alone = {(r.doc_id, r.mix_copies) for r in mixing.copies(docs.repartition(7)).collect()}
    assert alone == {(r.doc_id, r.mix_copies) for r in got}
    # A document's draw is its own: at the same rates, removing others changes nothing.
    rate = {r.source: min(3.0, r.mix_target / r.mix_source_size) for r in got if r.mix_source_size}
    unit = lambda r: (int(hashlib.md5(f"copy:{r.source or ''}:{r.doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    assert all(r.mix_copies == int(rate[r.source]) + (unit(r) < rate[r.source] % 1) for r in got if r.source in rate)
    monkeypatch.setattr(mixing, "FEW", 0)  # rates are joined, not broadcast
    again = mixing.copies(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.mix_copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.mix_copies for r in got)


# ---------------------------------------------------------------- 3: decontamination


def test_windows(spark, docs, rows):
    ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    own = [words(t, ALNUM) for _, t, _, _, _ in rows]
    long_ = next(w for w in own if len(w) > 200)
    items = [(1, " ".join(long_[10:40])), (2, "odd"), (30, None), (4, "?!"), (5, " ".join(long_[50:57])), (6, " ".join(long_[12:30]).upper()), (7, "x" * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {i: {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} for i, t in items if (w := words(t, ALNUM))}
    want = {}
    for (d, *_), w in zip(rows, own, strict=True):
        hit, found = set(), set()
        for i, ws in wins.items():
            for win in ws:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(i))
        want[d] = len(w), len(hit), sorted(found)
    for most in (1_000_000, 5):
        got = {r.doc_id: (r.hit_n_words, r.hit_n, list(r.hit_items)) for r in decontam.find_windows(docs, bench, max_windows=most).collect()}
        assert got == want
    kept = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, (n, h, _) in want.items() if not (h and 20 * h >= n)} and kept.columns == docs.columns
    clean = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert len(clean) == len(rows) and all(len(words(clean[d], ALNUM)) == n - h for d, (n, h, _) in want.items())
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, bench, remove="words")


# ---------------------------------------------------------------- 6: repeated passages


def repeats(rows):
    """n_bytes, n_removed, n_spans and kept_sha256 of each row, by a dictionary of all strings of 50 bytes."""
    seen, want = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        own, mask = [b[i : i + 50] for i in range(len(b) - 49)], bytearray(len(b))
        for i, w in enumerate(own):
            if seen.setdefault(w, d) != d:
                mask[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        want[d] = len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()
    return want


@pytest.mark.parametrize("bucket,at_once,hot", [(suffixes.BUCKET, suffixes.AT_ONCE, suffixes.HOT_BUCKET), (500, 40, 2)])
def test_repeats(spark, docs, rows, monkeypatch, bucket, at_once, hot):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(docs, at_once=at_once, hot_bucket=hot).collect()}
    assert got == repeats(rows)


@pytest.mark.parametrize("seed,hot", [(1, suffixes.HOT_BUCKET), (2, 5), (3, 20)])
def test_repeats_of_one_line_in_differing_surroundings(spark, seed, hot):
    """Frequent lines, periodic texts, zero bytes, and repeats that end a byte from each other."""
    rnd = random.Random(seed)
    line = "Licensed under terms that nobody has ever read to the end; see the file for what they say."
    alphabet = rnd.choice(["ab", "abcdefgh \n", "\0a\u00e9z"])
    texts = []
    for _ in range(70):
        noise = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
        cut = line[rnd.randrange(3) : len(line) - rnd.randrange(3)]
        texts.append(noise(rnd.randrange(60)) + rnd.choice([cut, "", "ab" * rnd.randrange(80), "x" * rnd.randrange(200)]) + noise(rnd.randrange(60)) + rnd.choice([line, ""]))
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(df, hot_bucket=hot).collect()} == repeats(rows)


def test_ranks_are_those_of_a_plain_suffix_order():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(11)
    bucket = np.array(sorted(rnd.randrange(4) for _ in range(300)))
    context = np.array([[rnd.randrange(2) for _ in range(30)] for _ in bucket], dtype=np.uint8)
    context[5:60] = context[4]
    place, same = suffixes._ranked(bucket, context)
    want = sorted(range(300), key=lambda i: (bucket[i], bytes(context[i])))
    assert np.argsort(place).tolist() == want
    shared = lambda a, b: next((k for k in range(30) if context[a][k] != context[b][k]), 30) if bucket[a] == bucket[b] else -1
    assert same.tolist() == [-1] + [shared(a, b) for a, b in zip(want, want[1:], strict=False)]

    # All suffixes of a text's runs: by shift, first bytes read backwards, anchor's rank; equal strings stand together, and only they.
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(50, 400))) for _ in range(12)] + ["ab" * 90, "a" * 120]
    data = [t.encode() for t in texts]
    every = np.arange(1 << 16, dtype=np.uint32)
    runs = suffixes._Runs(data, [(i, 0) for i in range(len(data))], [(suffixes._samples(d)[1] >> np.uint64(32)).astype(np.uint32) for d in data], 32)
    assert len(every) and {(d, a + k) for d, a, n in zip(runs.doc, runs.at, runs.size, strict=True) for k in range(n - 49)} == {(i, p) for i, d in enumerate(data) for p in range(len(d) - 49)}
    order = np.lexsort((runs.doc, runs.code))
    code, head, size, at, doc = (getattr(runs, c)[order] for c in ("code", "head", "size", "at", "doc"))
    buf, offsets = suffixes._bytes(pa.concat_arrays([runs.piece.take(pa.array(order))]))
    seen = []
    for t, own, new in suffixes.suffix_classes(np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])), buf, offsets[:-1], head, size):
        strings = [data[doc[r]][at[r] + head[r] - t :][:50] for r in own]
        keys = [(code[r], s[:t][::-1], s[t:]) for r, s in zip(own, strings, strict=True)]
        assert keys == sorted(keys) and new[1:].tolist() == [a != b for a, b in zip(strings, strings[1:], strict=False)]
        seen += [s for s, fresh in zip(strings, new, strict=True) if fresh]
    assert len(seen) == len(set(seen)) == len({d[p : p + 50] for d in data for p in range(len(d) - 49)})


def test_long_texts_are_read_in_parts(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(5)
    data = "".join(rnd.choice("abc") for _ in range(3000)).encode()
    codes = [[(suffixes._samples(data)[1] >> suffixes.np.uint64(32)).astype(suffixes.np.uint32).tobytes()]]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([8]), pa.array([data]), pa.array(codes, pa.list_(pa.binary()))], names=["key", "digest", "data", "codes"])
    strings = lambda part: sorted((code, at + k, piece[k : k + 50]) for b in suffixes._emit(32, 100)([batch]) for code, ats, piece in zip(b["code"].to_pylist(), b["ats"].to_pylist(), b["piece"].to_pylist(), strict=True) for at in ats for k in range(len(piece) - 49)) if monkeypatch.setattr(suffixes, "PART", part) is None else None
    whole = strings(1 << 20)
    assert len(whole) == len(data) - 49 and strings(512) == whole


def test_cover_reaches_every_shift():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_repeats_of_rows_without_or_with_the_same_id(spark):
    t = "abcdefghij" * 9 + "".join(map(str, range(60)))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t), (1, "short"), (2, "short")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert got == {(None, 0): 1, (3, 0): 2, (4, len(t)): 1, (1, 0): 1, (2, 0): 1}


# ---------------------------------------------------------------- 10: near duplicates


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n,percent,block,large", [(3, 85, 512, 8192), (5, 80, 4, 16)])
def test_near_duplicates(spark, docs, rows, monkeypatch, n, percent, block, large):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    monkeypatch.setattr(hyperminhash, "LARGE", large)
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component) for r in hyperminhash.near_duplicates(docs, n=n, percent=percent).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    assert len({root(d) for d in sets}) < len(sets)
    kept = hyperminhash.keep_one(docs, n=n, percent=percent)
    assert {r.doc_id for r in kept.collect()} == {root(d) for d in sets} and kept.columns == docs.columns


def test_near_duplicates_of_templates_and_of_one_text(spark):
    """Many texts that are half a template share bands but aren't linked; a group of edited copies is linked by its star, a chain of edits by pairs."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(70)]
    texts = [template[:35] + [word() for _ in range(35)] for _ in range(250)]  # similarity 0.3 and less of 0.5
    base = [word() for _ in range(120)]
    for _ in range(120):
        t = list(base)
        t[rnd.randrange(len(t))] = word()
        texts.append(t)
    chain = [word() for _ in range(150)]
    for _ in range(25):
        chain = list(chain)
        chain[rnd.randrange(len(chain))] = word()
        texts.append(chain)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    sets = {d: shingles(t, 3) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in hyperminhash.near_duplicates(df, n=3, percent=85).collect()}
    assert got == {d: root(d) for d in sets} and len(set(got.values())) >= 252


def test_estimate_is_near_the_similarity():
    import numpy as np

    rnd = np.random.default_rng(5)
    for n in (400, 5000, 100_000):
        pool = np.unique(rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        for share in (0.3, 0.8, 0.95):
            k = int(n * 2 * share / (1 + share))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:k], pool[n : 2 * n - k]]))
            (got,), (used,) = hyperminhash.estimate(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], np.array([float(n)]), np.array([float(n)]))
            assert abs(got - share) < 5 * np.sqrt(share * (1 - share) / used)


def test_block_products_count_intersections():
    import numpy as np

    rnd = np.random.default_rng(6)
    a, b = ([np.unique(rnd.integers(0, 300, 80).astype(np.uint64)) for _ in range(k)] for k in (7, 5))
    assert hyperminhash._common(a, b).tolist() == [[float(len(np.intersect1d(x, y))) for y in b] for x in a]


# ---------------------------------------------------------------- 4 and 7: classifiers


def test_languages(spark):
    rnd = random.Random(2)
    sounds = {"aa": ["ba", "ka", "la"], "bb": ["té", "ré", "né"], "cc": ["zu", "wu", "ßu"]}
    data = []
    for k in range(300):
        lang = rnd.choice(sorted(sounds))
        data.append((k, " ".join("".join(rnd.choice(sounds[lang]) for _ in range(3)) for _ in range(rnd.choice([3, 30]))), lang))
    data += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ?! 7", "cc"), (1003, "baba kala laba", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
    held = [(k, lang) for k, t, lang in data if k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 40 and all(got[k].lang_pred == lang for k, lang in held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and all(0 <= r.lang_score <= 1 for r in got.values())


def plain_counts(text):
    """n-grams one by one, hashed as the operator says."""
    if not any(c.isalpha() for c in text.lower()):
        return None
    run = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    found, m = [0] * langid.DIMENSIONS, 2**64
    a, b, c = (int(x) for x in langid._BY)
    for n in (1, 2, 3):
        for i in range(len(run) - n + 1):
            h = 0
            for k, ch in enumerate(run[i : i + n]):
                h = (h * c + ord(ch) * a) % m if k else ord(ch) * a % m
            found[((h ^ (h >> 29)) * b % m) >> 51] += 1
    return found


@pytest.mark.parametrize("part", [langid.PART, 7, 2, 1])
def test_counts_and_predictions_match_plain_loops(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    rnd = random.Random(part)
    texts = ["Hello, World 12!", "x", "a-b", "éÈ ñ  ß", "日本語 です", "12 ?!", "", "tail  "] + ["".join(rnd.choice("ab é.Z1") for _ in range(rnd.randrange(60))) for _ in range(60)]
    for t in texts:
        got = langid.counts(t)
        assert (None if got is None else got.tolist()) == plain_counts(t), t
    vectors = [c for t in texts if (c := plain_counts(t)) is not None]
    idf = [math.log((len(vectors) + 1) / (1 + sum(v[k] > 0 for v in vectors))) + 0.1 for k in range(langid.DIMENSIONS)]

    def unit(found):
        v = [math.log1p(x) * w for x, w in zip(found, idf, strict=True)]
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    import numpy as np

    centres = [unit(v) for v in vectors[:6]]
    known = langid.Languages(np.array(idf), list("aabbcc"), np.array(centres, dtype=np.float32), 0.4)
    for t in texts[6:]:
        name, score, rejected = known.predict(t)
        own = plain_counts(t)
        if own is None:
            assert (name, score) == ("und", 0.0)
            continue
        u = unit(own)
        cosines = [sum(x * y for x, y in zip(u, c, strict=True)) for c in centres]
        assert score == pytest.approx(max(cosines), abs=1e-5) and cosines["aabbcc".index(name)] >= max(cosines) - 1 and rejected == (score < 0.4)
        assert max(c for c, n in zip(cosines, "aabbcc", strict=True) if n == name) == pytest.approx(max(cosines), abs=1e-5)


def test_kneser_ney_matches_its_formula():
    """Interpolated Kneser-Ney with one discount, from dictionaries of counts."""
    import numpy as np

    text = b"kalo mites kalo vroga karog lotes kamikaze " * 3 + b"abcdefghijkl"
    keys, n = np.unique(toxicity._grams(text)[0], return_counts=True)
    full = {int(k): int(c) for k, c in zip(keys, n, strict=True)}
    counts = {toxicity.ORDER: full}
    for order in range(toxicity.ORDER - 1, 0, -1):
        counts[order] = Counter(k % 256**order for k in counts[order + 1])

    def p(k, order):
        if order == 0:
            return 1 / 256
        k %= 256**order
        same = [c for g, c in counts[order].items() if g >> 8 == k >> 8]
        return (max(counts[order][k] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * p(k, order - 1)) / sum(same)

    got = toxicity._kneser_ney(keys, n.astype(float))
    for order, (own, value) in got.items():
        assert value == pytest.approx([p(int(k), order) for k in own]) and set(map(int, own)) == set(counts[order])
    for context in {k >> 8 for k in counts[2]}:  # each context's letters, and what is left for new ones
        assert sum(p(k, 2) for k in counts[2] if k >> 8 == context) <= 1


def test_letters_outside_latin_and_long_texts():
    assert langid.counts("日本語") is not None and langid.counts("١٢٣ 😀 ---") is None and langid.counts("x" * (langid.PART + 5)) is not None


def test_toxicity(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tes", "ar"]) for _ in range(rnd.randint(1, 4)))
    data, labels = [], []
    for k in range(500):
        w = [word() for _ in range(rnd.choice([5, 40, 200]))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(1 + len(w) // 20):
                w[rnd.randrange(len(w))] = rnd.choice(["vrogg", "Zubix", "zubixes"])
        data.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    data += [(1000, None), (1001, ""), (1002, "vrogg " * 3), (1003, "kalo mites " * 90_000)]
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (77777, 1)], "doc_id long, toxic int")
    scorer = toxicity.learn(docs, known)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, scorer).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= toxicity.THRESHOLD) == bool(y) for k, y in held) >= 0.97 * len(held)
    assert all(0 <= x <= 1 for x in got.values()) and got[1000] == got[1001] < 0.3 and got[1002] > 0.5 and got[1003] < 0.3
    # Labels of held-out rows change nothing.
    flipped = known.withColumn("toxic", F.when(C.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.learn(docs, flipped)).collect()} == got
    kept = {r.doc_id for r in toxicity.reject(docs, known).collect()}
    assert kept == {k for k, x in got.items() if x < toxicity.THRESHOLD}


def test_toxic_word_inside_an_unseen_compound():
    ordinary, toxic = (b"kalo mites vroga karog lotes " * 20, b"kalo vrogg mites vrogg lotes " * 20)
    each = [dict(zip(*toxicity.np.unique(toxicity._grams(t)[0], return_counts=True), strict=True)) for t in (toxic, ordinary)]
    keys = toxicity.np.array(sorted({*each[0], *each[1]}), dtype=toxicity.np.uint64)
    counts = toxicity.np.array([[c.get(k, 0) for k in keys] for c in each], dtype=float)
    shorter = [keys]
    for order in range(7, 2, -1):
        shorter.append(toxicity.np.unique(shorter[-1] & toxicity._mask(order), return_counts=order == 3))
    low = toxicity._kneser_ney(*shorter[-1], 3)[3]
    model = toxicity.Model(keys, *counts, counts.sum(axis=1), low)
    last = lambda word: float(model.ratios(toxicity._grams(word)[0])[-1])
    assert last(b"vrogg") > 0.5 and last(b"mvrogg") > 0.5 and last(b"xyzmvrogg") > 0.5
    assert last(b"mvrogz") < 0  # the context is known, the letter isn't


def test_toxicity_learns_all_sequences(spark):
    rnd = random.Random(9)
    data = [(k, " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(6, 10))) for _ in range(150)) + (" vroggit" if k % 4 == 0 else "")) for k in range(600)]
    labels = [(k, int(k % 4 == 0)) for k in range(600)]
    docs, known = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = {w[max(0, i - 8) : i] for k, t in data if zlib.crc32(str(k).encode()) % 4 != 2 for w in t.split() for i in range(1, len(w) + 1)}
    whole = toxicity.learn(docs, known)
    assert len(want) > 300_000 and whole.sequences == len(want)
    # Smaller parts and labels that aren't broadcast give the same.
    dealt = toxicity.learn(docs, known, part=whole.sequences // 7, few=10)
    assert len(dealt.model.shared) > 6
    got, again = ({r.doc_id: r.toxicity for r in toxicity.score(docs, x).collect()} for x in (whole, dealt))
    assert got == pytest.approx(again, abs=1e-4)


# ---------------------------------------------------------------- 5: top-k


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, block):
    rnd = random.Random(9)
    data = [(k, [rnd.gauss(0, 0.2) for _ in range(8)]) for k in range(150)]
    data += [(200 + k, data[0][1]) for k in range(30)]  # ties
    data += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.1]), (304, [float("inf")] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    import numpy as np

    v = {k: [math.floor(64 * float(np.float32(x))) for x in e] for k, e in data if k < 300}
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 5, block=block, query_block=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = {}
    for q in (k for k in v if k % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q))[:5]
        want[q] = [(i, c, -s) for i, (s, c) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
    few = topk.top_k(df.filter("vec_id < 4"), df.filter("vec_id = 0"), 20).count()
    assert few == 3


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e9, 1e17, 1e30])
def test_top_k_of_any_finite_size(spark, scale):
    """Near ties of large components, rows of other lengths in any order, scores beyond a long."""
    rnd = random.Random(7)
    base = [rnd.gauss(0, 1) * scale for _ in range(6)]
    data = [(999, [0.5 * scale])] + [(k, [x + rnd.choice([0, 1, -1]) / 64 for x in base]) for k in range(60)]
    data += [(100 + k, [rnd.gauss(0, 1) * scale for _ in range(rnd.choice([0, 3, 6]))]) for k in range(40)]
    exact = {k: [math.floor(64 * x) if abs(x) < 2**52 else 64 * int(x) for x in e] for k, e in data}
    score = lambda a, b: sum(x * y for x, y in zip(exact[a], exact[b], strict=False))
    least, most = -(2**63), 2**63 - 1
    want = {}
    for q in (k for k in exact if k % 20 == 0):
        best = sorted((c for c in exact if c != q), key=lambda c: (-score(q, c), c))[:7]
        want[q] = [(i, c, min(max(score(q, c), least), most)) for i, c in enumerate(best, 1)]
    for rows in (data, data[::-1]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 7, block=32).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == want


def test_lists_are_read_until_outsiders_cannot_qualify():
    import numpy as np

    rnd = np.random.default_rng(3)
    v = np.floor(64 * rnd.exponential(1, (2000, 3)) ** 3)  # few large values: the lists' heads decide
    lists = topk.Lists(v)
    queries = np.floor(64 * rnd.normal(0, 1, (20, 3)))
    for q, places, depth in zip(queries, *topk.nra(queries, [[5]] * 20, lists, 10), strict=True):
        score = v @ q
        score[5] = -np.inf
        assert set(np.argsort(-score, kind="stable")[:10]) <= set(places) and 5 not in places
        assert depth < 2000 or (q <= 0).any()


# ---------------------------------------------------------------- 9: quotations


def test_quotations(spark):
    data = [
        (1, 0, "Hello there, how do I sort a list?\n\nAlso what about maps and sets?"),
        (1, 1, "Use the sort function of the list."),
        (1, 2, "> Use the sort function of the list.\n\nThank you, that works well."),
        (1, 3, "> > Use the sort function of the list.\n> Thank you, that works well.\nYou are welcome my friend."),
        (1, 4, "On Monday X wrote:\n> Also WHAT about   maps and sets?\nAny answer to this one?"),
        (2, 0, "> You are welcome my friend.\nI quote another thread."),
        (2, 1, None),
        (3, 0, "> circle two is here now\ncircle one is here now"),
        (4, 0, "> circle one is here now\ncircle two is here now"),
        (4, 1, "after the circle"),
        (None, 5, "alone"),
        (5, 0, "> nobody has ever said this\nreply"),
    ]
    df = spark.createDataFrame([(*r, "u", "x") for r in data], "conv_id long, turn long, text string, role string, q_text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df.withColumn("root", F.lit(1))).collect()}
    at = lambda s: None if s is None else (s.conv, s.turn)
    assert len(got) == len(data)
    assert {k: at(r.q_parent) for k, r in got.items()} == {
        (1, 0): None, (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (1, 4): (1, 0), (2, 0): (1, 3), (2, 1): (2, 0),
        (3, 0): None, (4, 0): (3, 0), (4, 1): (4, 0), (None, 5): None, (5, 0): None,
    }
    assert got[1, 4].q_text == "Any answer to this one?" and got[1, 3].q_linked == 2 and got[5, 0].q_linked == 0 and got[2, 1].q_text == ""
    assert {at(r.q_root) for k, r in got.items() if k[0] in (1, 2)} == {(1, 0)}
    for k, r in got.items():  # parents come first, places have no gap
        if r.q_parent is not None:
            p = got[at(r.q_parent)]
            assert r.q_depth == p.q_depth + 1 and r.q_position > p.q_position
    assert sorted(r.q_position for k, r in got.items() if at(r.q_root) == (1, 0)) == list(range(7))


def plain_links(rows):
    """(conv, turn) to (linked passages, parent), by asking every message for every quoted piece."""
    parsed = {r[:2]: quotes.parse(r[2]) for r in rows}
    order = lambda m: (m[0] is not None, m[0] or 0, m[1])
    before, last = {}, {}
    for m in sorted(parsed, key=order):
        before[m] = last.get(m[0])
        last[m[0]] = m
    known = {m: set(quotes.pieces(own)) for m, (own, _) in parsed.items()}
    found = {}
    for m, (_, quoted) in parsed.items():
        votes, linked = Counter(), set()
        for place, (level, passage) in enumerate(quoted):
            for piece in quotes.pieces(passage):
                near = [x for x in known if piece in known[x] and x[0] == m[0]]
                far = [x for x in known if piece in known[x] and x[0] != m[0] and len(piece) >= quotes.LEAST]
                near = [x for x in [min(near, key=order, default=m)] if order(x) < order(m)]
                if near or far:
                    source = near[0] if near else min(far, key=order)
                    linked.add(place)
                    if level == 1:
                        votes[source] += len(piece)
        best = max(votes, key=lambda x: (votes[x], x[0] == m[0], x[1] if x[0] == m[0] else 0, tuple(-y for y in order(x))), default=before[m])
        found[m] = len(linked), best
    return found


@pytest.mark.parametrize("seed", range(4))
def test_links_match_a_plain_search(spark, seed):
    rnd = random.Random(seed)
    said = ["Why not?", "ok", "the first long sentence of them all", "Another long sentence, said often", "this is said only now and then", "nothing like it was said before"]
    rows = []
    for conv in (None, 1, 2, 3, 7):
        for turn in range(rnd.randint(2, 9)):
            lines = [rnd.choice(["", "", "> ", ">> ", "> > "]) + rnd.choice(said).replace("long", rnd.choice(["long", "LONG", "long "])) for _ in range(rnd.randint(0, 5))]
            rows.append((conv, turn, rnd.choice(["\n", "\n\n", "\n"]).join(lines)))
    rows += [(9, 0, "> a sentence of message two\nasks"), (8, 1, "x"), (8, 2, "a sentence of message two"), (9, 5, "a sentence of message two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    at = lambda s: None if s is None else (s.conv, s.turn)
    got = {(r.conv_id, r.turn): (r.q_linked, at(r.q_parent)) for r in quotes.link(df).collect()}
    assert got == plain_links(rows) and got[9, 0] == (1, (8, 2))


def test_a_source_outside_the_own_conversation_is_found(spark):
    """The earliest message that says it is in the asker's conversation, but later; and short answers inside a conversation."""
    rows = [(1, 0, "hello"), (1, 1, "> to be or not to be\nyes"), (1, 2, "to be or not to be"), (2, 0, "to be or not to be"), (3, 0, "Why?"), (3, 1, "Because."), (3, 2, "> Why?\nI asked"), (4, 0, "> Why?\nhere too")]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 1].q_linked == 1 and tuple(got[1, 1].q_parent) == (2, 0)
    assert tuple(got[3, 2].q_parent) == (3, 0) and got[4, 0].q_parent is None and got[4, 0].q_linked == 0


def test_quote_levels():
    own, found = quotes.parse("a\n> b\n> c\n>> d\n>e\n\n\n\nf > g")
    assert own == "a\n\nf > g" and found == [(1, "b\nc"), (2, "d"), (1, "e")]


# ---------------------------------------------------------------- all: odd tables


def frames(spark):
    odd = [(None, None, None, None, None), (1, None, None, None, None), (1, "same id, other text", "en", "s", 1), (2, "kalo mites", "en", "s", 1), (2, "kalo mites", "en", "s", 1), (3, "", None, "", 0)]
    clash = ["key", "rep", "n", "hit_n", "mix_size", "__mix_u", "shard", "slot", "component", "digest", "pii_plain", "lang_pred", "toxicity", "cluster", "band", "fold"]
    base = spark.createDataFrame(odd, DOCS)
    yield "odd", base
    yield "empty", base.filter("false")
    yield "clash", base.select("*", *[F.lit("z").alias(c) for c in clash])


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, "kalo mites"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1), (None, None), (1, 0)], "doc_id long, toxic int")
    for name, df in frames(spark):
        n = df.count()
        assert pii.find_pii(df).count() == n and pii.redact(df).count() == n
        assert sharding.with_slots(sharding.assign_shards(df, "doc_id", sharding.even_tree(3)), "doc_id", ["doc_id"]).count() == n
        for b in (bench, bench.filter("false")):
            assert decontam.find_windows(df, b).count() == n
            assert decontam.decontaminate(df, b).columns == df.columns
        assert langid.identify(df, langid.learn(df)).count() == n
        assert suffixes.remove_repeats(df).count() == n
        for y in (labels, labels.filter("false")):
            assert toxicity.score(df, toxicity.learn(df, y)).count() == n
        assert toxicity.reject(df, labels).columns == df.columns
        vectors = df.withColumn("embedding", F.when(F.col("doc_id").isNotNull(), F.array(F.lit(0.5), F.col("doc_id").cast("double"))))
        top = topk.top_k(vectors, vectors, 3, key="doc_id").collect()
        assert all(r.query_id != r.id for r in top) and len(top) == (n > 0) * (2 * 3 + 2 * 3 + 3)
        said = df.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "q_text": F.lit("z"), "hash": F.lit("z")})
        assert quotes.conversations(said).count() == n
        assert mixing.copies(df).count() == n and mixing.mix(df).columns == df.columns
        assert hyperminhash.near_duplicates(df, n=3).count() == n and hyperminhash.keep_one(df).columns == df.columns, name


def test_the_driver_gives_back_memory_outside_the_heap(spark):
    """Also between the steps of an operator: each `cut` does it."""
    jvm = spark.sparkContext._jvm
    if jvm.java.lang.Runtime.version().feature() < 17 or not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("this JVM or system cannot tell")

    def held():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    codecs, some = [], bytearray(range(256)) * 400
    for _ in range(600):
        codecs.append(jvm.java.util.zip.Deflater())  # some 260 KB outside the heap, once used
        codecs[-1].setInput(some)
        codecs[-1].deflate(bytearray(100))
    last = codecs.pop()
    jvm.System.gc()
    before = held()
    for one in codecs:
        one.end()
    jvm.System.gc()
    kept = held()
    C.cut(spark.range(10))
    assert before - held() > 60 and kept - held() > 30
    last.end()
