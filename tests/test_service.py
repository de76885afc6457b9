"""The service, the command line, and every ledger query against its SQL."""

import importlib.util
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sealyard.__main__ import main
from sealyard.errors import Aborted, Conflict, Denied, DuplicateKey, Invalid, NotFound
from sealyard.operators import identity, locks, replication, transactions
from sealyard.operators.checkpoints import cut
from sealyard.plans.oracles import ORACLES
from sealyard.plans.queries import QUERIES
from sealyard.service import AuthConfig, Service

DATA = "/root/testdata/sf0.001"


class Clock:
    t = 1_000_000

    def __call__(self):
        self.t += 1
        return self.t


def test_read_write(spark, tmp_path):
    s = Service(spark, str(tmp_path), batch=2)
    assert s.write("a", "1")["success"] and not s.write("a", "2")["success"]
    assert s.read("a")["data"] == "1" and s.read("zz") == {"success": True, "data": None, "message": "Key not found"}
    assert s.write("AAEC/4BA", "/w==", "base64")["success"] and s.read("AAEC/4BA", "base64")["data"] == "/w=="
    rows = spark.createDataFrame([(0, "b", "1"), (1, "a", "x"), (2, "b", "2"), (3, "c", "3")], "position long, key string, value string")
    got = {r.position: r.status for r in s.batch_write(rows).collect()}
    assert got == {0: "accepted", 1: "duplicate_key", 2: "duplicate_in_batch", 3: "accepted"}
    bad = spark.createDataFrame([(0, "***", "1"), (1, "eA==", "eQ==")], "position long, key string, value string")
    assert {r.position: r.success for r in s.batch_write(bad, "base64").collect()} == {0: False, 1: True}
    s.ledger.seal()
    assert s.health() == {"status": "healthy", "total_records": 5, "blockchain_height": 2}


def test_transaction(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    ops = spark.createDataFrame([("t", 0, "put", b"k", b"1"), ("t", 1, "put", b"k", b"2"), ("t", 2, "get", b"k", None), ("u", 0, "put", b"k", b"9")], "tx_id string, op_seq int, kind string, key binary, value binary")
    seen = transactions.reads(ops, s.ledger.records()).first()
    assert bytes(seen.value) == b"2" and seen.from_own_write
    no = spark.createDataFrame([("t", True), ("t", False)], "tx_id string, vote boolean")
    with pytest.raises(Aborted):
        s.transaction(ops, "t", no)
    assert s.ledger.get(b"k") is None and s.transaction(ops, "t", no.filter("vote")) == 1 and s.ledger.get(b"k") == b"2"
    with pytest.raises(DuplicateKey):
        s.transaction(ops, "u")


def test_users(spark, tmp_path):
    clock = Clock()
    s = Service(spark, str(tmp_path), auth=AuthConfig(enabled=True, max_failures=2, session_seconds=100, lockout_seconds=50), clock=clock)
    with pytest.raises(Invalid):
        s.create_user("x", "weak", ["Read"])
    s.create_user("root", "Str0ng!pass", ["Admin"])
    s.create_user("ann", "Str0ng!pass", ["Write"])
    with pytest.raises(Invalid):
        s.create_user("ann", "Str0ng!pass", [])
    token, root = s.login("ann", "Str0ng!pass"), s.login("root", "Str0ng!pass")
    assert s.write("k", "v", token=token)["success"]
    for bad in (None, "nope"):
        with pytest.raises(Denied):
            s.write("k2", "v", token=bad)
    with pytest.raises(Denied):
        s.grant(token, "ann", "Admin")
    s.revoke(root, "ann", "Write")
    with pytest.raises(Denied):
        s.write("k3", "v", token=token)
    s.grant(root, "ann", "GrantPermission")
    assert s.permissions("ann") == ["GrantPermission"] and [(r.action, r.actor) for r in s.audit("ann").collect()] == [("grant", "system"), ("revoke", "root"), ("grant", "root")]
    s.logout(token)
    with pytest.raises(Denied):
        s.grant(token, "ann", "Read")
    with pytest.raises(NotFound):
        s.logout("nope")
    for _ in range(2):
        with pytest.raises(Denied):
            s.login("ann", "wrong")
    with pytest.raises(Denied, match="locked"):
        s.login("ann", "Str0ng!pass")
    clock.t += 60_000
    assert s.login("ann", "Str0ng!pass")
    clock.t += 200_000
    with pytest.raises(Denied, match="expired"):
        s.write("k4", "v", token=root)


def test_status(spark, tmp_path):
    clock = Clock()
    s = Service(spark, str(tmp_path), auth=AuthConfig(enabled=True), clock=clock)
    s.create_user("root", "Str0ng!pass", ["Admin"])
    s.create_user("bob", "Str0ng!pass", ["Read"])
    root = s.login("root", "Str0ng!pass")
    assert s.users() == ["bob", "root"] and s.status("bob") == "Active"
    s.set_status(root, "bob", "Suspended", clock.t + 500)
    with pytest.raises(Denied):
        s.login("bob", "Str0ng!pass")
    clock.t += 1000
    assert s.status("bob") == "Active" and s.login("bob", "Str0ng!pass")
    s.set_status(root, "bob", "Revoked")
    with pytest.raises(Denied):
        s.login("bob", "Str0ng!pass")


def test_transaction_object(spark, tmp_path):
    from sealyard.ledger import Ledger
    from sealyard.transaction import Transaction

    led = Ledger(spark, str(tmp_path / "l"))
    with Transaction(led) as t:
        t.put(b"a", b"1")
        assert t.get(b"a") == b"1" and t.get(b"b") is None and led.get(b"a") is None
    assert led.get(b"a") == b"1" and t.state == "Committed"
    with pytest.raises(ZeroDivisionError), Transaction(led) as t:
        t.put(b"b", b"2")
        raise ZeroDivisionError
    assert led.get(b"b") is None and t.state == "Aborted"
    with pytest.raises(DuplicateKey), Transaction(led) as t:
        t.put(b"c", b"3")
        t.put(b"a", b"9")
    assert led.get(b"c") is None
    clock = Clock()
    late = Transaction(led, timeout_ms=10, clock=clock)
    clock.t += 100
    with pytest.raises(Aborted):
        late.put(b"d", b"4")


def test_implications(spark):
    perms = identity.PERMISSIONS
    df = spark.createDataFrame([([p], w) for p in perms for w in perms], "held array<string>, wanted string")
    got = {(r.held[0], r.wanted) for r in df.withColumn("ok", identity.allows(F.col("held"), F.col("wanted"))).filter("ok").collect()}
    assert got == {(p, w) for p in perms for w in perms if p == w or p == "Admin" or (p, w) in {("Write", "Read"), ("ModifyUser", "CreateUser"), ("GrantPermission", "RevokePermission")}}


def test_deadlocks(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("x", "y"), ("y", "a")]
    got = {r.tx_id for r in locks.deadlocked(spark.createDataFrame(edges, "tx_id string, blocker string"), cut).collect()}
    assert got == {"a", "b", "c", "e", "f"}
    assert locks.deadlocked(spark.createDataFrame([], "tx_id string, blocker string"), cut).count() == 0
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)] + [(k, k + 1) for k in range(100, 108)] + [(108, 104), (200, 200)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start):
        found, stack = set(), list(after.get(start, ()))
        while stack:
            if (x := stack.pop()) not in found:
                found.add(x)
                stack += after.get(x, ())
        return found

    want = {a for a in after if a in reached(a) and (reached(a) - {a}) and any(a in reached(b) for b in after[a] - {a})}
    for small in (locks.SMALL, 5):
        got = {r.tx_id for r in locks.deadlocked(spark.createDataFrame(edges, "tx_id long, blocker long"), cut, small).collect()}
        assert got == want and len(want) > 8


def test_deadlocks_of_many_components(spark, monkeypatch):
    """More edges than one task searches: components are dealt to tasks, without rounds of joins, unless one of them alone is too large."""
    edges = [(f"{c}-{a}", f"{c}-{b}") for c in range(300) for a, b in ((0, 1), (1, 2), (2, 0 if c % 3 else 3), (3, 4), (4, 5))]
    want = {f"{c}-{k}" for c in range(300) if c % 3 for k in range(3)}
    rounds, plain = [], locks._labelled

    def counted(left, keep, small):
        rounds.append(left.count())
        return plain(left, keep, small)

    monkeypatch.setattr(locks, "_labelled", counted)
    got = [r.tx_id for r in locks.deadlocked(spark.createDataFrame(edges, "tx_id string, blocker string"), cut, 50).collect()]
    assert sorted(got) == sorted(want) and rounds == [0]
    ring = [(f"r{k}", f"r{(k + 1) % 60}") for k in range(60)]
    got = [r.tx_id for r in locks.deadlocked(spark.createDataFrame(edges + ring + [("r5", "0-0"), ("r5", "x")], "tx_id string, blocker string"), cut, 50).collect()]
    assert sorted(got) == sorted(want | {a for a, _ in ring}) and rounds == [0, 67]


def test_released_locks(spark):
    held = spark.createDataFrame([("a", "t1", "shared"), ("a", "t2", "shared"), ("b", "t2", "exclusive"), ("c", "t3", "exclusive")], "key string, tx_id string, mode string")
    gone = spark.createDataFrame([("a", "t1"), (None, "t2"), ("c", "t1")], "key string, tx_id string")
    assert [tuple(r) for r in locks.released(held, gone).collect()] == [("c", "t3", "exclusive")]


def test_append_entries_and_voters(spark):
    log = spark.createDataFrame([(i, 1, f"v{i}") for i in range(1, 6)], "index long, term long, value string")
    new = spark.createDataFrame([(4, 2, "w4")], "index long, term long, value string")
    assert [r.value for r in replication.appended(log, new, 3).orderBy("index").collect()] == ["v1", "v2", "v3", "w4"]
    with pytest.raises(Invalid):
        replication.appended(log, new, 6)


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    """A writer that comes between, and a key that is there: the transaction is aborted and nothing of it is written."""
    from sealyard.ledger import Ledger
    from sealyard.transaction import Transaction

    led = Ledger(spark, str(tmp_path / "l"))
    led.put(b"a", b"1", 1)
    commit = led.store.commit
    t = Transaction(led)
    t.put(b"b", b"2")
    led.store.commit = lambda base, **changes: (setattr(led.store, "commit", commit), Ledger(spark, str(tmp_path / "l")).put(b"c", b"3", 2), commit(base, **changes))[-1]
    with pytest.raises(Conflict):
        t.commit()
    assert t.state == "Aborted" and led.get(b"b") is None and led.get(b"c") == b"3"
    before = led.store.manifest()
    twice = spark.createDataFrame([(bytearray(b"x"), bytearray(b"1"), 1), (bytearray(b"c"), bytearray(b"2"), 2)], "key binary, value binary, timestamp long")
    with pytest.raises(DuplicateKey):
        led.append(twice, whole=True)
    assert led.get(b"x") is None and led.store.manifest() == before


def test_users_whose_names_begin_alike(spark, tmp_path):
    s = Service(spark, str(tmp_path / "s"), clock=Clock())
    for name, perms in (("a", ["Read"]), ("a:b", ["Write", "Admin"])):
        s.create_user(name, "Str0ng!pass", perms)
    assert s.permissions("a") == ["Read"] and s.permissions("a:b") == ["Admin", "Write"] and s.users() == ["a", "a:b"]


def test_commit_index_needs_the_current_term(spark):
    match = spark.createDataFrame([("n1", 5), ("n2", 4), ("n3", 2)], "node_id string, match_index long")
    log = spark.createDataFrame([("n1", i, 1 if i < 4 else 2) for i in range(1, 6)], "node_id string, index long, term long")
    assert [replication.commit_index(match, log, t).first()[0] for t in (1, 2, 3)] == [3, 4, 0]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "cli")
    assert main([path, "put", "a", "1"]) == 0 and main([path, "put", "a", "2"]) == 1
    assert main([path, "get", "a"]) == 0 and capsys.readouterr().out.splitlines()[-1] == "1"
    assert main([path, "get", "b"]) == 1
    assert main([path, "--batch", "1", "seal"]) == 0 and main([path, "--batch", "1", "verify"]) == 0
    assert main([path, "collections", "create", "c", "--description", "d"]) == 0 and main([path, "collections", "create", "c"]) == 1
    own = str(tmp_path / "users")
    assert main([own, "users", "create", "root", "--password", "Str0ng!pass", "--permissions", "Admin"]) == 0 and main([own, "users", "create", "root", "--password", "Str0ng!pass"]) == 1
    assert main([own, "users", "create", "bob", "--password", "Str0ng!pass", "--permissions", "Read"]) == 0
    capsys.readouterr()
    assert main([own, "users", "login", "root", "--password", "Str0ng!pass"]) == 0 and main([own, "users", "login", "root", "--password", "wrong"]) == 1
    token = capsys.readouterr().out.split()[0]
    assert main([own, "users", "grant", "bob", "--permissions", "Write", "--token", token]) == 0 and main([own, "users", "permissions", "bob"]) == 0
    assert capsys.readouterr().out.split() == ["Read", "Write"]
    assert main([own, "users", "logout", token]) == 0 and main([own, "users", "revoke", "bob", "--permissions", "Write", "--token", token]) == 1
    assert main([path, "collections", "verify"]) == 0 and main([path, "reset", "--yes"]) == 0 and main([path, "get", "a"]) == 1


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.skipif(not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="needs the shared tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "customer", "supplier", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    count = lambda d: Counter(tuple(map(plain, r)) for r in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None))
    assert count(a) == count(b)
