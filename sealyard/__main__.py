"""python -m sealyard PATH verb ...: put, get, load, list, stats, verify, seal, compact, reset, collections, users."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .collections import Collections
from .errors import LedgerError
from .ledger import Ledger
from .service import Service


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sealyard", description="A tamper-evident ledger on Spark.")
    p.add_argument("path", help="folder of the ledger, in any file system that Spark reads")
    p.add_argument("--batch", type=int, default=1000, help="records in a block")
    verbs = p.add_subparsers(dest="verb", required=True)
    put = verbs.add_parser("put")
    put.add_argument("key")
    put.add_argument("value")
    verbs.add_parser("get").add_argument("key")
    load = verbs.add_parser("load", help="append a Parquet table of key, value and timestamp")
    load.add_argument("table")
    ls = verbs.add_parser("list")
    ls.add_argument("--prefix", default="")
    ls.add_argument("--limit", type=int, default=100)
    ls.add_argument("--offset", type=int, default=0)
    seal = verbs.add_parser("seal")
    seal.add_argument("--force", action="store_true")
    verify = verbs.add_parser("verify")
    verify.add_argument("--chain-only", action="store_true")
    for name in ("stats", "compact"):
        verbs.add_parser(name)
    verbs.add_parser("reset").add_argument("--yes", action="store_true", required=True)
    coll = verbs.add_parser("collections")
    coll.add_argument("action", choices=("list", "create", "drop", "verify"))
    coll.add_argument("name", nargs="?")
    coll.add_argument("--description", default="")
    users = verbs.add_parser("users", help="of the service kept in PATH")
    users.add_argument("action", choices=("list", "create", "login", "logout", "permissions", "grant", "revoke"))
    users.add_argument("name", nargs="?", help="user, or session for logout")
    users.add_argument("--password", default="")
    users.add_argument("--permissions", default="", help="names, joined by commas")
    users.add_argument("--token", default="", help="session of who grants or revokes")
    return p


def _users(service: Service, a: argparse.Namespace) -> None:
    names = [x.strip() for x in a.permissions.split(",") if x.strip()]
    if a.action == "list":
        print("\n".join(service.users()))
    elif a.action == "create":
        service.create_user(a.name, a.password, names)
    elif a.action == "login":
        print(service.login(a.name, a.password))
    elif a.action == "logout":
        service.logout(a.name)
    elif a.action == "permissions":
        print("\n".join(service.permissions(a.name)))
    else:
        for permission in names:
            (service.grant if a.action == "grant" else service.revoke)(a.token, a.name, permission)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sealyard").getOrCreate()
    led = Ledger(spark, a.path, a.batch)
    try:
        if a.verb == "put":
            led.put(a.key.encode(), a.value.encode(), int(time.time() * 1000))
        elif a.verb == "get":
            value = led.get(a.key.encode())
            if value is None:
                print("Key not found")
                return 1
            print(value.decode("utf-8", "replace"))
        elif a.verb == "load":
            print(led.append(spark.read.parquet(a.table)))
        elif a.verb == "list":
            for r in led.page(a.prefix.encode(), a.limit, a.offset).select(F.col("key").cast("string")).collect():
                print(r[0])
        elif a.verb == "seal":
            print(led.seal(a.force))
        elif a.verb == "verify":
            good = led.verify(deep=not a.chain_only)
            print("integrity: ok" if good else "integrity: BROKEN")
            return 0 if good else 1
        elif a.verb == "stats":
            print(json.dumps(led.stats()))
        elif a.verb == "compact":
            led.compact()
        elif a.verb == "reset":
            led.reset()
        elif a.verb == "users":
            _users(Service(spark, a.path, a.batch), a)
        else:
            cols = Collections(spark, a.path, a.batch)
            if a.action == "list":
                print("\n".join(cols.names()))
            elif a.action == "verify":
                found = cols.verify()
                print(json.dumps(found))
                return 0 if all(found.values()) else 1
            elif a.action == "create":
                print(cols.create(a.name, a.description).meta["id"])
            else:
                cols.drop(a.name)
    except LedgerError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
