"""Each stage of the pipeline, on all that the stage before kept, against a plain version; and all queries' contracts in shape."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from sealyard.llm import toxicity
from sealyard.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tes", "ar", "un"]) for _ in range(rnd.randint(1, 4)))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    docs, labels = [], []
    for k in range(260):
        w = [word() for _ in range(rnd.choice([8, 60, 150]))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(1 + len(w) // 15):
                w[rnd.randrange(len(w))] = rnd.choice(["vrogg", "zubix"])
        if k % 9 == 0:
            w[2:2] = items[k % 5].split(" ")
        docs.append((k, " ".join(w), "en", f"s{k % 4}", len(w)))
        labels.append((k, 1, int(toxic)))
    for k in range(260, 330):
        t = rnd.choice(docs)[1].split(" ")
        if k % 2 and len(t) > 40:
            t[rnd.randrange(len(t))] = word()
        docs.append((k, " ".join(t), "en", "s0", len(t)))
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, [rnd.gauss(0, 0.2) for _ in range(6)], 0) for k in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(k // 3, k % 3, "user", word()) for k in range(20)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (t or "").translate(LOWER))


def near_kept(rows):
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d for d in sets if root(d) == d}


def clean(rows, items):
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {tuple(w[k : k + 13]) for t in items for w in [words(t, alnum)] for k in range(len(w) - 12)}
    kept = set()
    for r in rows:
        w, hit = words(r.text, alnum), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in wins:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(r.doc_id)
    return kept


def unit(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def mixed(rows):
    """How often each document is taken: targets by filling up, whole copies and a draw of its own for the rest."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    rate = {s: min(3.0, target[s] / sizes[s]) if sizes[s] else 0.0 for s in names}
    taken = {r.doc_id: int(rate[r.source]) + (unit(f"copy:{r.source or ''}:{r.doc_id}") < rate[r.source] % 1) for r in rows}
    return {d: n for d, n in taken.items() if n}


def descended(key):
    """The shard by three draws: two regions of two racks of four shards."""
    path, shards = "", {f"/region{g}/rack{r}": [4 * (2 * g + r) + k for k in range(4)] for g in range(2) for r in range(2)}
    for level in range(3):
        below = [f"/region{g}" for g in range(2)] if level == 0 else [f"{path}/rack{r}" for r in range(2)] if level == 1 else [f"{path}/{s}" for s in shards[path]]
        weight = (8, 4, 1)[level]
        path = min(below, key=lambda p: -math.log(unit(f"{key}:{p}")) / weight)
    return int(path.rsplit("/", 1)[1])


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        after = stage(spark, docs, sf_dir).cache()
        rows = after.collect()
        ids = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            score = {r.doc_id: r.t for r in toxicity.score(docs, toxicity.learn(docs, labels), name="t").collect()}
            assert set(ids) == {d for d, t in score.items() if t < 0.3}
            toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
            assert len(toxic & set(ids)) <= 2 and len([d for d in range(260) if d not in toxic and d not in ids]) <= 5
        elif name == "near_dedup":
            assert set(ids) == near_kept(before) and len(ids) < len(before)
        elif name == "decontamination":
            assert set(ids) == clean(before, items) and len(ids) < len(before)
        elif name == "mixing":
            assert ids == Counter(mixed(before)) and max(ids.values()) <= 3
        else:
            assert ids == Counter(r.doc_id for r in before) and after.columns == [*columns, "shard", "slot"]
            want = {r.doc_id: descended(r.doc_id) for r in rows}
            slots = {}
            for r in rows:
                assert r.shard == want[r.doc_id]
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if name != "sharding":
            assert after.columns == columns
        docs = after


def test_run(spark, sf_dir):
    one, two = P.run(spark, sf_dir), P.run(spark, sf_dir)
    assert one.columns[-2:] == ["shard", "slot"] and one.count() > 0
    assert sorted(one.select("doc_id", "shard", "slot").collect()) == sorted(two.select("doc_id", "shard", "slot").collect())


COLUMNS = {
    "op1": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op2": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9": {"conv_id": "bigint", "turn": "bigint"},
    "op10": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    types = dict(df.dtypes)
    assert COLUMNS[name.split("_")[0]].items() <= types.items()
    rows = df.collect()
    if name in ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
        want = con.sql(ORACLE_SQL[name]).fetchall()
        names = [c[0] for c in con.sql(ORACLE_SQL[name]).description]
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        assert Counter(tuple(plain(r[c]) for c in names) for r in rows) == Counter(tuple(map(plain, w)) for w in want)
