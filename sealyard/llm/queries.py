"""The contracts' queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hyperminhash, langid, mixing, pii, quotes, sharding, suffixes, topk, toxicity
from .common import fold, table

SHARDS = 16


def _span_text(spans):
    """kind:start:end, by kind as listed and then start, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the plain spans; n_disguised has those that only the rewritten text shows."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_plain", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(_span_text(F.col("pii_plain")).cast("binary"), 256).alias("base_sha256"),
        _span_text(F.concat("pii_plain", "pii_disguised")).alias("spans"),
        F.size("pii_disguised").cast("long").alias("n_disguised"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: null texts count as empty. Repeated ids go to one shard, each row with a slot of its own."""
    docs = table(spark, sf_dir, "documents")
    tree = sharding.even_tree(SHARDS)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"))
    rows = sharding.assign_shards(rows, "doc_id", tree)
    rows = sharding.with_slots(rows, "doc_id", ["doc_id", "text_crc32", "size"])
    return sharding.assign_shards(rows, "doc_id", sharding.with_shard(tree, SHARDS), "grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontam.find_windows(docs, benchmark).select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        F.col("hit_n").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang_pred is the nearest language, also where its distance rejects it: see `rejected`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"), k=20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), name="score")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


def op9_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each message, without its quotes: its parent (null for a root), its thread's root, and its place in the thread."""
    found = quotes.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return found.select(
        "conv_id",
        "turn",
        "role",
        F.col("q_parent.conv").alias("parent_conv_id"),
        F.col("q_parent.turn").alias("parent_turn"),
        F.col("q_root.conv").alias("root_conv_id"),
        F.col("q_root.turn").alias("root_turn"),
        F.col("q_depth").alias("depth"),
        F.col("q_position").alias("position"),
        F.col("q_quotes").cast("long").alias("n_quotes"),
        F.col("q_linked").cast("long").alias("n_linked"),
        F.col("q_text").alias("text"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_language": op4_language,
    "op5_top_k": op5_top_k,
    "op6_repeats": op6_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quotations": op9_quotations,
    "op10_near_dedup": op10_near_dedup,
}

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UNIT = "((('0x' || substr(md5({}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _leaf_sql(tree, name: str) -> str:
    """CTEs that bring each document down the tree."""
    nodes = [(path, c["path"], c["weight"]) for path, below in sharding._children(tree).items() for c in below]
    values = ", ".join(f"('{parent}', '{child}', {weight})" for parent, child, weight in nodes)
    out = f"{name}_nodes(parent, child, weight) AS (VALUES {values}), {name}0 AS (SELECT DISTINCT doc_id, '' AS path FROM documents)"
    for k in range(3):
        draw = f"-ln({_UNIT.format(f'''d.doc_id || ':' || n.child''')}) / n.weight"
        out += f", {name}{k + 1} AS (SELECT d.doc_id, arg_min(n.child, {draw}) AS path FROM {name}{k} d JOIN {name}_nodes n ON n.parent = d.path GROUP BY d.doc_id, d.path)"
    return out


_TREE = sharding.even_tree(SHARDS)



def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 by its table, byte by byte: DuckDB has no function for it."""
    table_ = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table_.append(c)
    step = f"xor(a >> 8, ({table_}::BIGINT[])[(xor(a, b) & 255) + 1])"
    data = f"hex(encode({text}))"
    codes = f"list_transform(range(0, (length({data}) // 2)::BIGINT), lambda p: ('0x' || substr({data}, (2 * p + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "op2_sharding": f"""
WITH {_leaf_sql(_TREE, "t")}, {_leaf_sql(sharding.with_shard(_TREE, SHARDS), "g")},
rows AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32,
  split_part(t3.path, '/', -1)::INT AS shard, split_part(g3.path, '/', -1)::INT AS grown_shard, floor({_UNIT.format("'slot:' || doc_id")} * {sharding.SLOT_BUCKETS}) AS bucket
  FROM documents JOIN t3 USING (doc_id) JOIN g3 USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM rows""",
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_repeats": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
marks AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, -1) AS new FROM hits),
runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marks) GROUP BY doc_id, k),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z0 FROM runs),
kept AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z0 + 1, 2 * (a - z0)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS p FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b),
least_ AS (SELECT a AS doc_id, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)""",
    "op8_mixing": """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, (('0x' || substr(md5('copy:' || coalesce(source, '') || ':' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM documents),
sizes AS (SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
ratios AS (SELECT *, 3.0 * source_size AS bound, 3.0 * source_size / weight AS ratio FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level FROM ratios WINDOW e AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
plan AS (SELECT source, source_size, least(bound, chosen.level * weight) AS target FROM levels, chosen),
rated AS (SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN least(3.0, p.target / p.source_size) ELSE 0.0 END AS rate FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies FROM rated)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, size * copies AS taken, copies FROM counted""",
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
found AS (SELECT doc_id, p, places.n, item_id FROM places JOIN wins ON wins.n = places.n AND wins.win = places.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
