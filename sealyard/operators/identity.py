"""Users, permissions, sessions and audit, from logs of events."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import identity_hash
from .chains import linked
from .ordering import numbered

#: Identities that one task links.
PART = 250_000

# The permissions, those that one of them brings along besides itself, and those for administrators only.
PERMISSIONS = [
    "Read", "Write", "Delete",
    "BeginTransaction", "CommitTransaction", "RollbackTransaction",
    "CreateUser", "ModifyUser", "DeleteUser", "GrantPermission", "RevokePermission",
    "ViewStats", "ViewHealth", "ViewClusterStatus", "ModifyClusterConfig",
    "ViewBlockchain", "VerifyIntegrity",
    "Admin",
]
ADMIN_ONLY = ["CreateUser", "ModifyUser", "DeleteUser", "GrantPermission", "RevokePermission", "ModifyClusterConfig", "Admin"]
BRINGS = {"Write": ["Read"], "ModifyUser": ["CreateUser"], "GrantPermission": ["RevokePermission"]}


def implied() -> dict[str, list[str]]:
    """Each permission with all that it implies, itself included; Admin implies every one."""
    return {p: sorted({*PERMISSIONS} if p == "Admin" else {p, *BRINGS.get(p, [])}) for p in PERMISSIONS}


def allows(permissions: Column, wanted: Column) -> Column:
    """Whether any of an array of permissions implies the wanted one."""
    table = F.create_map(*[x for p, names in implied().items() for x in (F.lit(p), F.array(*map(F.lit, names)))])
    return F.exists(permissions, lambda p: (p == wanted) | F.coalesce(F.array_contains(F.try_element_at(table, p), wanted), F.lit(False)))


# What new users are often given.
PRESETS = {
    "admin": ["Admin"],
    "read_only": ["Read", "ViewStats", "ViewHealth"],
    "read_write": ["Read", "Write", "BeginTransaction", "CommitTransaction", "RollbackTransaction", "ViewStats", "ViewHealth"],
}


def is_admin_only(permission: Column) -> Column:
    """Whether a permission is for administrators."""
    return permission.isin(ADMIN_ONLY)


def holds(permissions: Column, wanted: Column) -> Column:
    """Exact membership, without what permissions imply."""
    return F.coalesce(F.array_contains(permissions, wanted), F.lit(False))


def merged(one: Column, other: Column) -> Column:
    """The union of two permission sets, sorted."""
    return F.array_sort(F.array_union(one, other))


def with_permission(permissions: Column, added: Column) -> Column:
    return merged(permissions, F.array(added))


def without_permission(permissions: Column, removed: Column) -> Column:
    return F.array_sort(F.array_except(permissions, F.array(removed)))


def operations_of(operations: DataFrame, user: str) -> DataFrame:
    """A user's signed operations, by nonce."""
    return operations.filter(F.col("user_id") == user).orderBy("nonce")


def effective(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """(user_id, permission) in force: the last event of each is a grant."""
    rows = events if as_of is None else events.filter(F.col("ts") <= as_of)
    last = rows.groupBy("user_id", "permission").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    return last.filter("action = 'grant'").select("user_id", "permission")


def decisions(requests: DataFrame, users: DataFrame, granted: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds decision to requests (user_id, wanted): allowed, unknown_user, inactive, or denied."""
    if not enabled:
        return requests.withColumn("decision", F.lit("allowed"))
    held = granted.groupBy("user_id").agg(F.collect_set("permission").alias("held"))  # at most one of each permission
    rows = requests.join(users.select("user_id", "active"), "user_id", "left").join(held, "user_id", "left")
    decision = (
        F.when(F.col("active").isNull(), "unknown_user")
        .when(~F.col("active"), "inactive")
        .when(F.coalesce(allows(F.col("held"), F.col("wanted")), F.lit(False)), "allowed")
        .otherwise("denied")
    )
    return rows.withColumn("decision", decision).drop("active", "held")


def audit_trail(events: DataFrame, user: str | None = None) -> DataFrame:
    rows = events if user is None else events.filter(F.col("user_id") == user)
    return rows.orderBy("ts", "event_id")


def status_at(changes: DataFrame, now: int) -> DataFrame:
    """(user_id, status): the last change up to now; a suspension that has run out is over."""
    last = changes.filter(F.col("ts") <= now).groupBy("user_id").agg(F.max_by(F.struct("status", "until"), F.struct("ts", "event_id")).alias("s"))
    over = (F.col("s.status") == "Suspended") & (F.col("s.until") <= now)
    return last.select("user_id", F.when(over, "Active").otherwise(F.col("s.status")).alias("status"))


def active_sessions(sessions: DataFrame, now: int, ended: DataFrame | None = None) -> DataFrame:
    """Sessions that haven't expired (now < expires_at) and weren't logged out."""
    live = sessions.filter(F.col("expires_at") > now)
    return live if ended is None else live.join(ended.select("session_id"), "session_id", "left_anti")


def session_users(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """(session_id, user_id, active) of sessions that haven't expired, with their user; sessions of unknown users are left out."""
    return active_sessions(sessions, now).join(users.select("user_id", "active"), "user_id").select("session_id", "user_id", "active")


def failure_streaks(logins: DataFrame) -> DataFrame:
    """(user_id, streak): failed logins since the last success."""
    good = logins.filter("success").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    after = F.col("last").isNull() | (F.struct("ts", "event_id") > F.col("last"))
    rows = logins.join(good, "user_id", "left")
    return rows.groupBy("user_id").agg(F.count_if(~F.col("success") & after).alias("streak"))


def locked(logins: DataFrame, most: int, now: int | None = None, lockout_ms: int | None = None) -> DataFrame:
    """Users whose streak has reached `most`; with a lockout time, only while it lasts since the last failure."""
    found = failure_streaks(logins).filter(F.col("streak") >= most)
    if lockout_ms is None:
        return found
    last = logins.filter("NOT success").groupBy("user_id").agg(F.max("ts").alias("last_failure"))
    return found.join(last, "user_id").filter(F.lit(now) - F.col("last_failure") < lockout_ms).drop("last_failure")


def next_nonce(operations: DataFrame) -> DataFrame:
    return operations.groupBy("user_id").agg((F.max("nonce") + 1).alias("next_nonce"))


def replays(operations: DataFrame) -> DataFrame:
    """(user_id, nonce) that more than one operation has used."""
    return operations.groupBy("user_id", "nonce").agg(F.count("*").alias("uses")).filter("uses > 1")


def conditions_hold(conditions: Column, now: Column, operations: Column, ip: Column, second_factor: Column) -> Column:
    """All of an array of (kind, low, high, list): TimeRange, MaxOperations, IPWhitelist, RequireAdditionalAuth."""
    return F.forall(
        conditions,
        lambda c: F.when(c["kind"] == "TimeRange", (now >= c["low"]) & (now <= c["high"]))
        .when(c["kind"] == "MaxOperations", operations < c["high"])
        .when(c["kind"] == "IPWhitelist", F.array_contains(c["list"], ip))
        .when(c["kind"] == "RequireAdditionalAuth", second_factor)
        .otherwise(False),
    )


def valid_at(valid_from: Column, valid_until: Column, now: Column) -> Column:
    """Both ends belong to the interval; an open end has no bound."""
    return (valid_from.isNull() | (valid_from <= now)) & (valid_until.isNull() | (now <= valid_until))


def role_permissions(assignments: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, permission) from (user_id, role) and (role, permission)."""
    return assignments.join(roles, "role").select("user_id", "permission").distinct()


def hashed(identities: DataFrame) -> DataFrame:
    return identities.withColumn("identity_hash", identity_hash("user_id", "public_key", "creation_block", "creation_timestamp", "permissions_root"))


def identity_chain(identities: DataFrame, previous: bytes | None = None, part: int = PART) -> DataFrame:
    """Adds chain_hash in the order of `position`: the first is the identity's own hash, each other hashes the one before and its own.

    One after another by nature, `part` identities in a task, over new identities only: give the stored tip as `previous`.
    """
    lean = hashed(identities)
    names = lean.columns

    def link(batches, last):
        for batch in batches:
            out = []
            for h in batch.column("identity_hash").to_pylist():
                last = h if last is None else hashlib.sha256(last + h).digest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "chain_hash"])

    placed = numbered(lean, "position", name="__place", start=0)
    return linked(placed, F.floor(F.col("__place") / part), "position", link, lean.withColumn("chain_hash", F.lit(b"")).schema, "chain_hash", previous)


def verify_identity_chain(chain: DataFrame) -> DataFrame:
    """(position, ok) of each identity, all at once: its hash, and its link to the one before."""
    true = hashed(chain.drop("identity_hash")).withColumnRenamed("identity_hash", "true_hash")
    before = chain.select((F.col("position") + 1).alias("position"), F.col("chain_hash").alias("before"))
    first = chain.agg(F.min("position").alias("first"))
    rows = true.join(chain.select("position", "identity_hash"), "position").join(before, "position", "left").crossJoin(F.broadcast(first))
    link = F.when(F.col("position") == F.col("first"), F.col("chain_hash") == F.col("true_hash")).otherwise(F.col("chain_hash") == F.unhex(F.sha2(F.concat("before", "true_hash"), 256)))
    return rows.select("position", F.coalesce((F.col("identity_hash") == F.col("true_hash")) & link, F.lit(False)).alias("ok"))
