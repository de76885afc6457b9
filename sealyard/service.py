"""What clients of a ledger ask for, as methods: writes and reads with encodings, users and sessions, health and statistics.

State is kept in logs (users, sessions, permission events) that are ledgers of their own; decisions are queries over them.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Aborted, Denied, DuplicateKey, Invalid, LedgerError, NotFound
from .functions import codec
from .ledger import Ledger
from .operators import identity, scans, transactions
from .operators.checkpoints import cut


@dataclass(frozen=True)
class AuthConfig:
    enabled: bool = False
    session_seconds: int = 3600
    max_failures: int = 5
    lockout_seconds: int = 1800
    password_length: int = 8
    strong_passwords: bool = True
    reads_need_auth: bool = False


class Service:
    """clock gives milliseconds; it is a parameter so that runs can be repeated."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 1000, auth: AuthConfig | None = None, clock=None):
        self.spark, self.auth = spark, auth or AuthConfig()
        self.ledger = Ledger(spark, f"{path}/data", batch)
        self.log = Ledger(spark, f"{path}/auth", batch)
        self.now = clock or (lambda: int(time.time() * 1000))

    # ------------------------------------------------------------ data

    def write(self, key: str, value: str, encoding: str = "utf8", token: str | None = None) -> dict:
        self._authorise(token, "Write")
        k, v = self._bytes(key, encoding), self._bytes(value, encoding)
        try:
            self.ledger.put(k, v, self.now())
        except DuplicateKey:
            return {"success": False, "message": "duplicate key"}
        return {"success": True, "message": "written"}

    def read(self, key: str, encoding: str = "utf8", token: str | None = None) -> dict:
        if self.auth.reads_need_auth:
            self._authorise(token, "Read")
        row = scans.get(self.ledger.records(), self._bytes(key, encoding)).select(codec.encode_field("value", F.lit(encoding)).alias("v")).first()
        return {"success": True, "data": None, "message": "Key not found"} if row is None else {"success": True, "data": row.v, "message": "found"}

    def batch_write(self, rows: DataFrame, encoding: str = "utf8", token: str | None = None) -> DataFrame:
        """rows: (key, value) as text, and `position`, their order. Each is its own write; the answer has a status for each row."""
        self._authorise(token, "Write")
        decoded = rows.select("position", codec.decode_field("key", F.lit(encoding)).alias("key"), codec.decode_field("value", F.lit(encoding)).alias("value"), F.lit(self.now()).alias("timestamp"))
        good = decoded.filter(F.col("key").isNotNull() & F.col("value").isNotNull())
        status = cut(self.ledger.with_status(good, "position"))  # before the append changes the ledger that it was read from
        self.ledger.append(good, "position", ties=[])
        bad = decoded.filter(F.col("key").isNull() | F.col("value").isNull()).withColumn("status", F.lit("not_decodable"))
        return status.unionByName(bad).select("position", "status", (F.col("status") == "accepted").alias("success"))

    def transaction(self, operations: DataFrame, tx_id: str, votes: DataFrame | None = None) -> int:
        """Applies the puts of one transaction's operations together, if all participants vote for it. How many were new."""
        own = operations.filter(F.col("tx_id") == tx_id)
        if votes is not None:
            decision = transactions.two_phase(votes.filter(F.col("tx_id") == tx_id)).first()
            if decision is None or decision.decision != "commit":
                raise Aborted(tx_id)
        puts = transactions.write_sets(own.filter("lower(kind) = 'put'"))
        return self.ledger.append(puts.select("key", "value", F.lit(self.now()).alias("timestamp"), "op_seq"), "op_seq", ties=[], whole=True)

    def health(self) -> dict:
        s = self.ledger.stats()
        return {"status": "healthy", "total_records": s["records"], "blockchain_height": s["height"]}

    def stats(self, reads: DataFrame | None = None) -> dict:
        out = self.ledger.stats()
        return out if reads is None else out | scans.hit_miss(reads, self.ledger.records()).first().asDict()

    @staticmethod
    def _bytes(x: str, encoding: str) -> bytes:
        import base64

        return base64.b64decode(x, validate=True) if encoding == "base64" else x.encode()

    # ------------------------------------------------------------ users and sessions

    def _events(self, kind: str, fields: str, user: str | None = None) -> DataFrame:
        """(event_id, ts, fields) of one kind of event; of one user it is a range of keys, as they begin with the user."""
        rows = self.log.prefix(f"{kind}:{user}:".encode() if user is not None else f"{kind}:".encode())
        found = rows.select(F.col("sequence_number").alias("event_id"), F.col("timestamp").alias("ts"), F.from_json(F.col("value").cast("string"), fields).alias("e")).select("event_id", "ts", "e.*")
        return found if user is None else found.filter(F.col("user_id") == user)  # another user's name may go on with a colon

    def _note(self, kind: str, name: str, **what) -> None:
        self.log.put(f"{kind}:{name}".encode(), json.dumps(what).encode(), self.now())

    def _add(self, kind: str, user: str, **what) -> None:
        self._note(kind, f"{user}:{uuid.uuid4().hex}", user_id=user, **what)

    def create_user(self, user: str, password: str, permissions: list[str]) -> None:
        ok = self.spark.range(1).select(codec.password_ok(F.lit(password), self.auth.password_length, self.auth.strong_passwords)).first()[0]
        unknown = [p for p in permissions if p not in identity.PERMISSIONS]
        if not ok or unknown:
            raise Invalid(f"unknown permissions {unknown}" if unknown else "the password breaks the policy")
        salt = os.urandom(32)
        try:
            self._note("user", user, user_id=user, salt=salt.hex(), hash=hashlib.sha256(password.encode() + salt).hexdigest())
        except DuplicateKey:
            raise Invalid(f"there is a user {user!r}") from None
        for p in permissions:
            self._add("permission", user, permission=p, action="grant", actor="system")

    def login(self, user: str, password: str) -> str:
        stored = self.log.get(f"user:{user}".encode())
        if stored is None:
            raise NotFound(user)
        found = json.loads(stored)
        if self.status(user) != "Active":
            raise Denied("the account is not active")
        log = self._events("login", "user_id string, success boolean", user)
        if identity.locked(log, self.auth.max_failures, self.now(), self.auth.lockout_seconds * 1000).first() is not None:
            raise Denied("the account is locked")
        good = hashlib.sha256(password.encode() + bytes.fromhex(found["salt"])).hexdigest() == found["hash"]
        self._add("login", user, success=good)
        if not good:
            raise Denied("wrong user or password")
        token = uuid.uuid4().hex
        self._note("session", token, session_id=token, user_id=user, expires_at=self.now() + self.auth.session_seconds * 1000)
        return token

    def users(self) -> list[str]:
        return [u.user_id for u in self._events("user", "user_id string").select("user_id").orderBy("user_id").toLocalIterator()]

    def status(self, user: str) -> str:
        """Active unless the last change says otherwise; a suspension ends by itself."""
        found = identity.status_at(self._events("status", "user_id string, status string, until long", user), self.now()).first()
        return "Active" if found is None else found.status

    def set_status(self, token: str, user: str, status: str, until: int | None = None) -> None:
        """Active, Suspended (until a time, or open) or Revoked."""
        actor = self._authorise(token, "ModifyUser", always=True)
        if status not in ("Active", "Suspended", "Revoked"):
            raise Invalid(status)
        self._add("status", user, status=status, until=until, actor=actor)

    def logout(self, token: str) -> None:
        if not self.log.exists(f"session:{token}".encode()):
            raise NotFound("no such session")
        self._note("ended", token, session_id=token)

    def _permission_events(self, user: str | None = None) -> DataFrame:
        return self._events("permission", "user_id string, permission string, action string, actor string", user)

    def _change(self, action: str, token: str, user: str, permission: str) -> None:
        actor = self._authorise(token, "GrantPermission" if action == "grant" else "RevokePermission", always=True)
        if not self.log.exists(f"user:{user}".encode()):
            raise NotFound(user)
        self._add("permission", user, permission=permission, action=action, actor=actor)

    def grant(self, token: str, user: str, permission: str) -> None:
        self._change("grant", token, user, permission)

    def revoke(self, token: str, user: str, permission: str) -> None:
        self._change("revoke", token, user, permission)

    def permissions(self, user: str) -> list[str]:
        return sorted(r.permission for r in identity.effective(self._permission_events(user)).collect())  # at most one of each

    def audit(self, user: str | None = None) -> DataFrame:
        return identity.audit_trail(self._permission_events(user), user)

    def _authorise(self, token: str | None, permission: str, always: bool = False) -> str:
        if not (self.auth.enabled or always):
            return "anonymous"
        row = scans.get(self.log.records(), f"session:{token}".encode()).first()
        if row is None or self.log.exists(f"ended:{token}".encode()):
            raise Denied("no such session")
        session = json.loads(bytes(row.value))
        if self.now() >= session["expires_at"]:
            raise Denied("the session has expired")
        asked = self.spark.createDataFrame([(session["user_id"], permission)], "user_id string, wanted string")
        users = asked.select("user_id", F.lit(self.status(session["user_id"]) == "Active").alias("active"))
        if identity.decisions(asked, users, identity.effective(self._permission_events(session["user_id"]))).first().decision != "allowed":
            raise Denied(permission)
        return session["user_id"]


__all__ = ["AuthConfig", "LedgerError", "Service"]
