"""The same queries in SQL."""

from __future__ import annotations

import math

from ..operators.identity import implied
from .inputs import BATCH

ZERO = "unhex('" + "00" * 32 + "')"


def be8(x: str) -> str:
    return f"unhex(printf('%016x', ({x})::BIGINT))"


def le8(x: str) -> str:
    return "unhex(" + " || ".join(f"substr(printf('%016x', ({x})::BIGINT), {15 - 2 * k}, 2)" for k in range(8)) + ")"


def sha(x: str) -> str:
    return f"unhex(sha256({x}))"


PUTS = "p AS (SELECT encode('order:' || o_orderkey) AS key, encode(o_orderstatus || '|' || o_orderpriority) AS value, epoch_ms(o_orderdate) AS ts, o_orderkey AS n FROM orders)"
RECORDS = f"{PUTS}, r0 AS (SELECT *, row_number() OVER (ORDER BY n) AS seq FROM p), r AS (SELECT *, {sha(f'key || value || {be8("ts")} || {be8("seq")}')} AS hash FROM r0)"


def _roots() -> str:
    """CTEs l0, l1, ...: the levels of each block's tree; roots(b, root, n, ts, joined)."""
    out = f"l0 AS (SELECT (seq - 1) // {BATCH} + 1 AS b, (seq - 1) % {BATCH} AS i, hash AS h, count(*) OVER (PARTITION BY (seq - 1) // {BATCH}) AS n FROM r)"
    top = math.ceil(math.log2(BATCH))
    for k in range(top):
        out += f""", l{k + 1} AS (SELECT b, i // 2 AS i, CASE WHEN n = 1 THEN h ELSE {sha('h || coalesce(s, h)')} END AS h, (n + 1) // 2 AS n
  FROM (SELECT a.b, a.i, a.h, a.n, s.h AS s FROM l{k} a LEFT JOIN l{k} s ON s.b = a.b AND s.i = a.i + 1 WHERE a.i % 2 = 0))"""
    out += f""", roots AS (SELECT l.b, l.h AS root, g.n, g.ts, g.joined FROM l{top} l JOIN (SELECT (seq - 1) // {BATCH} + 1 AS b, count(*) AS n, max(ts) // 1000 AS ts, unhex(string_agg(hex(hash), '' ORDER BY seq)) AS joined FROM r GROUP BY 1) g USING (b))"""
    return out


_PRE = f"{be8('b')} || {be8('ts')} || prev || root || {be8('0')} || joined"
CHAIN = f"""{RECORDS}, {_roots()}, complete AS (SELECT * FROM roots WHERE n = {BATCH}),
chain AS (SELECT 0::BIGINT AS b, 0::BIGINT AS ts, {ZERO} AS prev, {ZERO} AS root, {sha(f"{be8('0')} || {be8('0')} || {ZERO} || {ZERO} || {be8('0')}")} AS hash, 0::BIGINT AS n
  UNION ALL SELECT f.b, f.ts, c.hash, f.root, {sha(f"{be8('f.b')} || {be8('f.ts')} || c.hash || f.root || {be8('0')} || f.joined")}, f.n FROM chain c JOIN complete f ON f.b = c.b + 1)"""
DOCS = "d AS (SELECT encode(lang || ':' || source || ':' || doc_id) AS key, encode(text) AS value, doc_id AS ts FROM documents)"
LINES = "l AS (SELECT encode(l_orderkey || ':' || l_linenumber) AS key, encode(l_partkey || '|' || l_suppkey || '|' || l_quantity::INT || '|' || l_returnflag) AS value, epoch_ms(l_shipdate) AS ts, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn, l_orderkey, l_linenumber FROM lineitem)"
LOG = """log AS (SELECT * FROM (SELECT (event_id // 5)::VARCHAR AS tx_id, CASE WHEN event_id % 5 = 0 THEN 'begin' WHEN event_id % 5 = 1 THEN CASE WHEN event_id // 5 % 4 = 3 THEN 'commit' ELSE 'prepare' END
  WHEN event_id % 5 = 2 AND event_id // 5 % 4 = 0 THEN 'commit' WHEN event_id % 5 = 2 AND event_id // 5 % 4 = 1 THEN 'abort' END AS event, event_id * 1000 AS ts, event_id AS log_pos FROM events) WHERE event IS NOT NULL),
last AS (SELECT tx_id, arg_max(event, log_pos) AS event, min(ts) FILTER (event = 'begin') AS started FROM log GROUP BY tx_id)"""
OPS = """ops AS (SELECT (event_id // 5)::VARCHAR AS tx_id, event_id % 5 AS op_seq, ['put', 'get', 'delete'][event_id // 2 % 3 + 1] AS kind, 'order:' || (user_id % 4) AS key, event_type || event_id AS value FROM events)"""
HELD = "held AS (SELECT 'k' || user_id AS key, (event_id % 97)::VARCHAR AS tx_id, min(CASE WHEN event_id % 8 = 0 THEN 'exclusive' ELSE 'shared' END) AS mode FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)"
WANTED = "wanted AS (SELECT 'k' || (user_id % 170) AS key, (event_id % 97)::VARCHAR AS tx_id, CASE WHEN event_id % 3 = 0 THEN 'exclusive' ELSE 'shared' END AS mode, event_id AS requested_at FROM events WHERE event_id % 2 = 1)"
GRANTS = f"""{HELD}, {WANTED}, state AS (SELECT key, count(*) AS n, count(*) FILTER (mode = 'exclusive') AS x FROM held GROUP BY key),
granted AS (SELECT w.key, w.tx_id, w.mode, CASE WHEN h.mode = 'exclusive' THEN true WHEN w.mode = 'shared' AND h.mode IS NOT NULL THEN true WHEN w.mode = 'shared' THEN coalesce(s.x, 0) = 0
  ELSE coalesce(s.n, 0) = CASE WHEN h.mode IS NULL THEN 0 ELSE 1 END END AS granted FROM (SELECT DISTINCT key, tx_id, mode FROM wanted) w LEFT JOIN state s USING (key) LEFT JOIN held h USING (key, tx_id))"""
RAFT = """log AS (SELECT * FROM (SELECT 'n' || (event_id % 5) AS node_id, event_id // 5 + 1 AS index, (event_id // 5 + 1) // 50 + 1 AS term, 'k' || (event_id // 5 + 1) AS key, 'v' || (event_id // 5 + 1 + CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END) AS value FROM events)
  WHERE index <= (SELECT max(event_id) // 5 + 1 - (max(event_id) // 5 + 1) * substr(node_id, 2, 1)::INT // 20 FROM events)), quorum AS (SELECT list_reverse_sort(list(m))[3] AS q FROM (SELECT max(index) AS m FROM log GROUP BY node_id)), lasts AS (SELECT node_id, max(index) AS last_index, arg_max(term, index) AS last_term FROM log GROUP BY node_id)"""
VOTES = """votes AS (SELECT c.node_id AS candidate, v.node_id, (v.node_id <> 'n1' OR c.node_id = 'n1') AND (c.last_term, c.last_index) >= (v.last_term, v.last_index) AS granted FROM lasts c, lasts v)"""
STATES = """st AS (SELECT (user_id % 20)::VARCHAR AS node_id, event_id AS seq, event_id // 40 - CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS term, CASE WHEN event_id % 13 = 0 THEN 'Leader' WHEN event_id % 3 = 0 THEN 'Candidate' ELSE 'Follower' END AS state FROM events)"""
PERMS = """pe AS (SELECT event_id, event_id * 10 AS ts, 'u' || user_id AS user_id, ['Read', 'Write', 'ModifyUser', 'GrantPermission', 'ViewStats', 'Admin'][CASE WHEN event_id % 61 = 0 THEN 5 ELSE event_id % 5 END + 1] AS permission,
  CASE WHEN event_id // 3 % 3 = 0 THEN 'revoke' ELSE 'grant' END AS action, 'root' AS actor FROM events)"""
COLLS = f"""{PUTS}, {DOCS}, c AS (SELECT 'orders' AS id, octet_length(key) + octet_length(value) AS size, ts FROM p UNION ALL SELECT 'documents', octet_length(key) + octet_length(value), ts FROM d
  UNION ALL SELECT 'customers', octet_length(encode(c_custkey::VARCHAR)) + octet_length(encode(c_name)), 5 FROM customer)"""
LOGINS = "l AS (SELECT event_id, event_id * 10 AS ts, user_id::VARCHAR AS user_id, event_id % 4 = 0 AS success FROM events), good AS (SELECT user_id, max(event_id) AS last FROM l WHERE success GROUP BY 1), streaks AS (SELECT user_id, count(*) FILTER (NOT success AND (last IS NULL OR event_id > last)) AS streak, max(ts) FILTER (NOT success) AS failed FROM l LEFT JOIN good USING (user_id) GROUP BY 1)"
IDS = f"""i0 AS (SELECT c_custkey AS position, c_name AS user_id, {sha('c_name')} AS pk, c_custkey % 7 AS cb, c_custkey * 1000 AS ct, {sha("CASE WHEN c_custkey % 2 = 0 THEN 'ReadWrite' ELSE 'Read' END")} AS pr FROM customer),
i1 AS (SELECT *, {sha(f"encode(user_id) || pk || {le8('cb')} || {le8('ct')} || pr")} AS h FROM i0), i2 AS (SELECT *, row_number() OVER (ORDER BY position) AS k FROM i1),
ch AS (SELECT k, position, user_id, h, h AS c FROM i2 WHERE k = 1 UNION ALL SELECT i.k, i.position, i.user_id, i.h, {sha('ch.c || i.h')} FROM ch JOIN i2 i ON i.k = ch.k + 1)"""
_IMPLIED = ", ".join(f"('{p}', '{w}')" for p, ws in implied().items() for w in ws)
_PROOF_TOP = math.ceil(math.log2(BATCH))
_STEPS = "".join(
    f" UNION ALL SELECT t.hash, {k} AS level, CASE WHEN s.h IS NULL THEN NULL ELSE CASE WHEN (t.place >> {k}) % 2 = 1 THEN 'L' ELSE 'R' END || lower(hex(s.h)) END AS step FROM targets t LEFT JOIN l{k} s ON s.b = t.b AND s.i = xor(t.place >> {k}, 1)"
    for k in range(_PROOF_TOP)
).removeprefix(" UNION ALL ")

ORACLES: dict[str, str] = {
    "ledger_blocks": f"WITH RECURSIVE {CHAIN} SELECT b AS index, ts AS timestamp, lower(hex(prev)) AS previous_hash, lower(hex(root)) AS merkle_root, lower(hex(hash)) AS hash, n AS n_records, true AS valid FROM chain",
    "record_hash": f"WITH {RECORDS} SELECT decode(key) AS key, seq AS sequence_number, lower(hex(hash)) AS hash FROM r",
    "merkle_root_per_block": f"WITH {RECORDS}, {_roots()} SELECT b AS index, lower(hex(root)) AS merkle_root, n AS n_records FROM roots WHERE n = {BATCH}",
    "verify_chain": f"SELECT true AS valid, 1 + count(*) // {BATCH} AS blocks FROM orders",
    "verify_tampered": f"""WITH {RECORDS}, b AS (SELECT (seq - 1) // {BATCH} + 1 AS index, count(*) AS n, bool_or(seq % 1000 = 7) AS bad FROM r GROUP BY 1 HAVING n = {BATCH})
SELECT index, 'chain' AS mode, true AS ok FROM b UNION ALL SELECT index, 'deep', NOT bad FROM b""",
    "merkle_proof": f"""WITH {RECORDS}, {_roots()}, targets AS (SELECT hash, (seq - 1) // {BATCH} + 1 AS b, (seq - 1) % {BATCH} AS place FROM r WHERE (seq - 1) // {BATCH} + 1 IN (SELECT b FROM roots WHERE n = {BATCH})),
steps AS ({_STEPS}) SELECT lower(hex(t.hash)) AS hash, t.b AS index, t.place::INT AS place, coalesce(string_agg(step, ',' ORDER BY level), '') AS proof FROM targets t JOIN steps s ON s.hash = t.hash GROUP BY t.hash, t.b, t.place""",
    "proof_roundtrip": f"SELECT true AS proved, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, count(*) OVER () AS total FROM orders) WHERE seq <= total // {BATCH} * {BATCH}",
    "forced_blocks": f"WITH {RECORDS}, {_roots()} SELECT b AS index, n AS n_records, (b - 1) * {BATCH} + 1 AS first_sequence, lower(hex(root)) AS merkle_root FROM roots",
    "chain_tip": f"WITH {RECORDS}, {_roots()}, f AS (SELECT * FROM roots WHERE n = {BATCH}) SELECT b AS index, n AS n_records, lower(hex(root)) AS merkle_root, b + 1 AS length FROM f WHERE b = (SELECT max(b) FROM f)",
    "block_by_index": f"WITH {RECORDS}, {_roots()} SELECT b AS index, ts AS timestamp, n AS n_records, (b - 1) * {BATCH} + 1 AS first_sequence, lower(hex(root)) AS merkle_root FROM roots WHERE b = 7",
    "integrity_of_all": "SELECT true AS chain_valid, v AS identities_valid, v AS valid, p AS people FROM (VALUES (true, 'true'), ((SELECT count(*) = 0 FROM customer WHERE c_custkey = 100), 'forged')) t(v, p)",
    "point_get": f"WITH {PUTS} SELECT decode(key) AS key, decode(value) AS value FROM p WHERE key = encode('order:7')",
    "multi_get": f"WITH {RECORDS} SELECT decode(key) AS key, decode(value) AS value, seq AS sequence_number FROM r WHERE key IN (SELECT encode('order:' || l_orderkey) FROM lineitem WHERE l_quantity > 45)",
    "key_exists": "SELECT 'order:' || c_custkey * 3 AS key, c_custkey * 3 IN (SELECT o_orderkey FROM orders) AS found FROM customer",
    "scan_range": f"WITH {PUTS} SELECT decode(key) AS key, decode(value) AS value FROM p WHERE key >= encode('order:2') AND key < encode('order:5')",
    "scan_prefix": f"WITH {DOCS} SELECT decode(key) AS key, ts AS timestamp FROM d WHERE decode(key) LIKE 'en:src1%'",
    "latest_by_prefix": f"WITH {PUTS} SELECT decode(key) AS key, decode(value) AS value FROM p WHERE decode(key) LIKE 'order:9%' ORDER BY p.key DESC LIMIT 1",
    "scan_in_order": f"WITH {PUTS} SELECT decode(key) AS key, ts AS timestamp FROM p",
    "first_last_key": f"WITH {DOCS} SELECT decode(min(key)) AS first_key, decode(max(key)) AS last_key, count(*) AS n FROM d",
    "list_docs_page": f"WITH {DOCS}, f AS (SELECT * FROM d WHERE decode(key) LIKE 'de:%') SELECT decode(key) AS key, ts AS timestamp, (SELECT count(*) FROM f) AS total_count, 75 < (SELECT count(*) FROM f) AS has_more FROM f ORDER BY f.key LIMIT 25 OFFSET 50",
    "recovered_log": "SELECT user_id || ':' || event_type AS key, 'v' || max(event_id) AS value, max(event_id) AS sequence_number FROM events GROUP BY user_id, event_type",
    "cache_fresh": "SELECT event_id, event_id * 17 % 5000 AS ts FROM events WHERE 5000 - event_id * 17 % 5000 < 1000",
    "api_hit_miss": "WITH k AS (SELECT event_id % 997 IN (SELECT o_orderkey FROM orders) AS hit FROM events) SELECT count(*) AS reads, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses FROM k",
    "append_accept": f"WITH {LINES} SELECT decode(key) AS key, decode(value) AS value, ts AS timestamp FROM l WHERE rn = 1",
    "append_records": f"""WITH {PUTS}, q AS (SELECT *, 100000 + row_number() OVER (ORDER BY n) AS seq FROM p WHERE n % 3 <> 0)
SELECT decode(key) AS key, seq AS sequence_number, sha256(key || value || {be8("ts")} || {be8("seq")}) AS hash FROM q""",
    "batch_status": f"WITH {LINES} SELECT CASE WHEN l_linenumber = 1 AND l_orderkey % 10 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) THEN 'duplicate_key' WHEN rn = 1 THEN 'accepted' ELSE 'duplicate_in_batch' END AS status, count(*) AS n FROM l GROUP BY 1",
    "compact_lww": "SELECT key, arg_max(event_id, run) AS event_id FROM (SELECT user_id || ':' || event_type AS key, event_id % 7 AS run, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY key",
    "level_info": "SELECT event_id % 3 AS level, count(*) AS runs, sum(event_id % 11 + 1)::BIGINT AS rows, count(*) > pow(10, event_id % 3 + 1) AS due FROM events GROUP BY 1",
    "record_size": f"WITH {DOCS} SELECT decode(key) AS key, (octet_length(key) + octet_length(value) + 80)::BIGINT AS size FROM d",
    "encode_base64": "SELECT doc_id, sha256(to_base64(encode(text))) AS encoded_sha256, octet_length(encode(text))::BIGINT AS n_bytes FROM documents",
    "lossy_text": "SELECT doc_id, substr(text, 1, 1) || chr(65533) || substr(text, 2, 20) AS shown FROM documents WHERE text IS NOT NULL",
    "listed_fields": "SELECT c_custkey, unnest([c_name, c_mktsegment, 'x']) AS field FROM customer",
    "operation_hash": f"WITH {OPS} SELECT tx_id, op_seq, kind, sha256(encode(upper(kind)) || encode(key) || CASE WHEN kind = 'put' THEN encode(value) ELSE ''::BLOB END || encode(tx_id) || {le8('op_seq')} || {le8('1700000000')}) AS hash FROM ops",
    "password_policy": "SELECT c_custkey, octet_length(encode(p)) >= 8 AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[^A-Za-z0-9]') AS ok, sha256(encode(p) || encode('salt')) AS hash FROM (SELECT c_custkey, substr(c_mktsegment, 1, 3) || lower(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END AS p FROM customer)",
    "collection_stats": f"WITH {COLLS} SELECT coalesce(id, 'empty') AS collection_id, count(id) AS document_count, coalesce(sum(size), 0)::BIGINT AS total_size_bytes, max(ts) AS last_updated FROM c FULL JOIN (SELECT 'empty' AS e) ON c.id = e GROUP BY 1",
    "total_stats": f"WITH {COLLS} SELECT count(DISTINCT id) AS collections, count(*) AS documents, sum(size)::BIGINT AS bytes FROM c",
    "stats_rollup": f"WITH {COLLS} SELECT id AS collection_id, count(*) AS documents, sum(size)::BIGINT AS bytes FROM c GROUP BY ROLLUP (id)",
    "schema_violations": """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'document: not JSON' WHEN 1 THEN 'k: missing' WHEN 2 THEN 'k: not Integer;name: MinLength;name: OneOf'
  ELSE CASE WHEN (props->>'$.k')::INT < 10 THEN 'k: MinValue' WHEN (props->>'$.k')::INT > 90 THEN 'k: MaxValue' ELSE '' END END AS violations FROM events""",
    "index_lookup": "SELECT c_nationkey, c_custkey::VARCHAR AS key FROM customer WHERE c_nationkey = 7",
    "index_unique_violations": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING n > 1",
    "cross_collection_join": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "txn_final_state": f"WITH {LOG} SELECT tx_id, CASE event WHEN 'begin' THEN 'Active' WHEN 'prepare' THEN 'Preparing' WHEN 'commit' THEN 'Committed' ELSE 'Aborted' END AS state FROM last",
    "txn_illegal_steps": f"""WITH {LOG}, s AS (SELECT *, lag(event) OVER (PARTITION BY tx_id ORDER BY log_pos) AS previous FROM log)
SELECT tx_id, event, previous, log_pos FROM s WHERE NOT CASE event WHEN 'begin' THEN previous IS NULL WHEN 'prepare' THEN coalesce(previous = 'begin', false) WHEN 'commit' THEN coalesce(previous = 'prepare', false) ELSE previous IS NOT NULL END""",
    "txn_expired": f"WITH {LOG} SELECT tx_id, started FROM last WHERE event IN ('begin', 'prepare') AND 1000000 - started > 30000",
    "txn_active_count": f"WITH {LOG} SELECT count(*) FILTER (event IN ('begin', 'prepare')) AS active FROM last",
    "txn_write_set": f"WITH {OPS} SELECT tx_id, key, arg_max(CASE kind WHEN 'put' THEN value ELSE '' END, op_seq) AS value, max(op_seq) AS op_seq FROM ops WHERE kind <> 'get' GROUP BY tx_id, key",
    "txn_reads_own_writes": f"""WITH {OPS}, w AS (SELECT *, last_value(CASE kind WHEN 'put' THEN value WHEN 'delete' THEN '' END IGNORE NULLS) OVER (PARTITION BY tx_id, key ORDER BY op_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM ops)
SELECT tx_id, op_seq, key, coalesce(own, o_orderstatus || '|' || o_orderpriority) AS value, own IS NOT NULL AS from_own_write FROM w LEFT JOIN orders ON key = 'order:' || o_orderkey WHERE kind = 'get'""",
    "txn_committed_writes": f"WITH {LOG}, {OPS} SELECT tx_id, key, arg_max(value, op_seq) AS value, any_value(c.ts) AS timestamp FROM ops JOIN (SELECT tx_id, max(ts) AS ts FROM log WHERE event = 'commit' GROUP BY 1) c USING (tx_id) WHERE kind = 'put' GROUP BY tx_id, key",
    "txn_read_set": f"WITH {OPS} SELECT DISTINCT tx_id, key FROM ops WHERE kind = 'get'",
    "txn_lookup": f"WITH {LOG}, {OPS} SELECT l.tx_id, 'Preparing' AS state, started, op_seq, kind, key, value FROM last l JOIN ops USING (tx_id) WHERE l.tx_id = '6' AND event = 'prepare'",
    "locks_released": f"WITH {HELD} SELECT * FROM held WHERE NOT (tx_id::INT % 7 = 0 AND mode = 'shared') AND tx_id::INT % 5 <> 0",
    "two_phase_decision": "SELECT (event_id % 300)::VARCHAR AS tx_id, CASE WHEN bool_and(event_id % 31 <> 0) THEN 'commit' ELSE 'abort' END AS decision FROM events GROUP BY 1",
    "lock_grantable": f"WITH {GRANTS} SELECT * FROM granted",
    "lock_queue": f"""WITH {WANTED}, q AS (SELECT *, row_number() OVER o AS place, sum((mode = 'exclusive')::INT) OVER o AS x FROM wanted WINDOW o AS (PARTITION BY key ORDER BY requested_at, tx_id))
SELECT key, tx_id, requested_at, (mode = 'exclusive' AND place = 1) OR x = 0 AS granted FROM q""",
    "wait_for_graph": f"WITH {GRANTS} SELECT DISTINCT g.tx_id, h.tx_id AS blocker FROM granted g JOIN held h USING (key) WHERE NOT g.granted AND g.tx_id <> h.tx_id",
    "deadlock_members": """WITH RECURSIVE w AS (SELECT event_id AS a, unnest([event_id - event_id % 100 + (event_id * 7 + 3) % 100, event_id - event_id % 100 + user_id % 100]) AS b FROM events WHERE event_id % 3 <> 0), e AS (SELECT DISTINCT a::VARCHAR AS a, b::VARCHAR AS b FROM w WHERE a <> b),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT a AS tx_id FROM reach WHERE a = b""",
    "raft_last_entries": f"WITH {RAFT} SELECT * FROM lasts",
    "raft_commit_index": f"WITH {RAFT} SELECT term, coalesce(max(index) FILTER (index <= (SELECT q FROM quorum)), 0) AS commit_index FROM log GROUP BY term",
    "raft_applied": f"WITH {RAFT} SELECT key, value, index FROM log WHERE node_id = 'n0' AND index <= (SELECT q FROM quorum) AND index % 10 <> 0",
    "raft_append": f"WITH {RAFT}, p AS (SELECT last_index * 2 // 3 AS p FROM lasts WHERE node_id = 'n3') SELECT 'n3' AS node_id, index, term, key, value FROM log, p WHERE (node_id = 'n3' AND index <= p) OR (node_id = 'n0' AND index > p)",
    "raft_leader": f"WITH {STATES} SELECT arg_max(node_id, (term, seq)) AS leader_id, max(term) AS term FROM st WHERE state = 'Leader'",
    "raft_illegal_states": f"WITH {STATES}, l AS (SELECT *, lag(state) OVER w AS s, lag(term) OVER w AS t FROM st WINDOW w AS (PARTITION BY node_id ORDER BY seq)) SELECT node_id, seq, term, state FROM l WHERE term < t OR (state = 'Leader' AND s = 'Follower')",
    "raft_incomplete_leaders": f"WITH {RAFT}, done AS (SELECT DISTINCT index, term FROM log WHERE index <= (SELECT q FROM quorum)), leaders AS (SELECT DISTINCT term, 'n' || (term % 5) AS leader_id FROM log) SELECT l.term, leader_id, count(*) AS missing FROM leaders l JOIN done d ON d.term < l.term WHERE NOT EXISTS (SELECT 1 FROM log g WHERE g.node_id = l.leader_id AND g.index = d.index AND g.term = d.term) GROUP BY 1, 2",
    "raft_read_only": "SELECT CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'put' END AS kind, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
    "raft_votes": f"WITH {RAFT}, {VOTES} SELECT * FROM votes",
    "raft_election": f"WITH {RAFT}, {VOTES} SELECT 9 AS term, candidate, count(*) FILTER (granted) AS votes, count(*) FILTER (granted) >= 3 AS won FROM votes GROUP BY candidate",
    "raft_unapplied": f"WITH {RAFT} SELECT node_id, index, key FROM log, quorum WHERE index > q // 2 AND index <= q",
    "raft_leader_safety": "SELECT event_id // 100 AS term, count(DISTINCT CASE WHEN event_id % 700 = 0 THEN 'n2' ELSE 'n1' END) AS leaders FROM events GROUP BY 1 HAVING leaders > 1",
    "raft_log_mismatches": f"WITH {RAFT} SELECT index, term, count(DISTINCT key || '/' || value) AS versions FROM log GROUP BY index, term HAVING versions > 1",
    "node_urls": "SELECT s_suppkey, 'http://node' || s_suppkey || ':' || (s_suppkey + 9000) AS url FROM supplier",
    "node_health": "SELECT user_id % 20 AS node_id, max(event_id) AS last_seen, (SELECT max(event_id) FROM events) - max(event_id) <= 15 AS healthy FROM events GROUP BY 1",
    "permission_effective": f"WITH {PERMS} SELECT user_id, permission FROM pe WHERE ts <= 50000 GROUP BY 1, 2 HAVING arg_max(action, event_id) = 'grant'",
    "permission_check": f"""WITH {PERMS}, g AS (SELECT user_id, permission FROM pe GROUP BY 1, 2 HAVING arg_max(action, event_id) = 'grant'), i(p, w) AS (VALUES {_IMPLIED}),
u AS (SELECT 'u' || c_custkey AS user_id, c_custkey % 5 <> 0 AS active FROM customer WHERE c_custkey <> 3), q AS (SELECT 'u' || c_custkey AS user_id, unnest(['Read', 'Write', 'CreateUser', 'RevokePermission', 'ModifyClusterConfig']) AS wanted FROM customer)
SELECT q.user_id, q.wanted, CASE WHEN active IS NULL THEN 'unknown_user' WHEN NOT active THEN 'inactive' WHEN EXISTS (SELECT 1 FROM g JOIN i ON i.p = g.permission WHERE g.user_id = q.user_id AND i.w = q.wanted) THEN 'allowed' ELSE 'denied' END AS decision FROM q LEFT JOIN u USING (user_id)""",
    "permission_sets": f"""WITH {PERMS}, g AS (SELECT user_id, permission AS p FROM pe GROUP BY 1, 2 HAVING arg_max(action, event_id) = 'grant'), h AS (SELECT user_id, list(p) AS held FROM g GROUP BY 1),
t(p) AS (VALUES ('Read'), ('Write'), ('BeginTransaction'), ('CommitTransaction'), ('RollbackTransaction'), ('ViewStats'), ('ViewHealth'))
SELECT user_id, array_to_string(list_sort(list_distinct(held || ['Delete'])), ',') AS added, array_to_string(list_sort(list_filter(held, lambda x: x <> 'Read')), ',') AS removed,
  array_to_string(list_sort(list_distinct(held || (SELECT list(p) FROM t))), ',') AS merged, list_contains(held, 'Read') AS exact, list_contains(held, 'Read') OR list_contains(held, 'Write') OR list_contains(held, 'Admin') AS implied FROM h""",
    "admin_grants": f"WITH {PERMS} SELECT event_id, user_id, permission, action FROM pe WHERE permission IN ('ModifyUser', 'GrantPermission', 'Admin')",
    "user_operations": "SELECT user_id::VARCHAR AS user_id, event_id AS nonce, event_type FROM events WHERE user_id = 7",
    "audit_trail": f"WITH {PERMS} SELECT * FROM pe WHERE user_id = 'u7'",
    "account_status": """WITH c AS (SELECT event_id, user_id::VARCHAR AS user_id, event_id * 10 AS ts, ['Active', 'Suspended', 'Revoked'][event_id % 3 + 1] AS status, CASE WHEN event_id % 2 = 0 THEN event_id * 10 + 3000 END AS until FROM events)
SELECT user_id, CASE WHEN arg_max(status, event_id) = 'Suspended' AND coalesce(max_by({'u': until}, event_id).u <= 60000, false) THEN 'Active' ELSE arg_max(status, event_id) END AS status FROM c WHERE ts <= 60000 GROUP BY user_id""",
    "sessions_active": "SELECT event_id::VARCHAR AS session_id, user_id, event_id * 10 + 3600 AS expires_at FROM events WHERE event_id * 10 + 3600 > 50000 AND event_id % 6 <> 0",
    "session_users": "SELECT event_id::VARCHAR AS session_id, user_id::VARCHAR AS user_id, c_custkey % 5 <> 0 AS active FROM events JOIN customer ON user_id = c_custkey WHERE event_id * 10 + 3600 > 50000",
    "lockout_streak": f"WITH {LOGINS} SELECT user_id, streak FROM streaks",
    "locked_accounts": f"WITH {LOGINS} SELECT user_id, streak FROM streaks WHERE streak >= 3 AND 100000 - failed < 60000",
    "nonce_replay": "SELECT user_id, event_id % 50 AS nonce, count(*) AS uses FROM events GROUP BY 1, 2 HAVING uses > 1",
    "next_nonce": "SELECT user_id, max(event_id % 50) + 1 AS next_nonce FROM events GROUP BY 1",
    "identity_chain": f"WITH RECURSIVE {IDS} SELECT position, user_id, lower(hex(h)) AS identity_hash, lower(hex(c)) AS chain_hash FROM ch",
    "identity_chain_verify": "SELECT c_custkey AS position, c_custkey <> 100 AS ok FROM customer",
    "temporal_permission": "SELECT event_id, event_id - 10 <= 5000 AND (event_id % 4 = 0 OR 5000 <= event_id + 10) AS valid FROM events",
    "access_conditions": "SELECT event_id, event_id + 3 <= event_id + user_id % 7 AND event_id % 10 < 8 AND event_id % 3 IN (1, 2) AS allowed FROM events",
    "living_records": f"WITH {DOCS} SELECT decode(key) AS key, ts * 1000 AS timestamp FROM d WHERE 600000 - ts * 1000 < 300000",
    "log_suffix": f"WITH {RAFT} SELECT node_id, index, term FROM log WHERE index >= 90",
    "role_permissions": "SELECT DISTINCT user_id, permission FROM events JOIN (VALUES (0, 'Read'), (1, 'Write'), (1, 'Read'), (2, 'Admin')) r(k, permission) ON event_id % 3 = k",
}
