"""A store from the command line: python -m lodestrata PATH COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import Config, parse_sections
from .schema import InvalidKey
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata", description="Read and write a store of versioned keys.")
    top.add_argument("path")
    top.add_argument("--config", help="a file of settings by section")
    top.add_argument("--checkpoint", help="read this checkpoint instead of the store")
    top.add_argument("--user", help="take a token of this user's quota first")
    of = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, pages: bool = False) -> None:
        own = of.add_parser(name)
        for a in arguments:
            own.add_argument(a)
        if pages:
            own.add_argument("--page", type=int, default=1)
            own.add_argument("--size", type=int, default=10)

    command("put", "key", "value"), command("get", "key"), command("delete", "key")
    command("range", "start", "end", pages=True), command("prefix", "prefix", pages=True)
    command("iterate-range", "start", "end"), command("iterate-prefix", "prefix")
    command("versions", "key"), command("flush"), command("compact", "level"), command("runs"), command("validate", "run")
    command("checkpoint-create", "name"), command("checkpoints"), command("checkpoint-delete", "name")
    return top


def text(value: bytes | None) -> str:
    return "" if value is None else bytes(value).decode(errors="replace")


def show(rows: DataFrame, *names: str) -> None:
    for r in rows.select(*names).toLocalIterator():
        print("\t".join(text(v) if isinstance(v, bytes | bytearray | None) else str(v) for v in r))


def run(store: Store, a: argparse.Namespace) -> int:
    """0, or 1 where something is missing or doesn't hold."""
    if a.command == "put":
        store.put(a.key, a.value.encode())
    elif a.command == "delete":
        store.delete(a.key)
    elif a.command == "get":
        value = store.get(a.key)
        if value is None:
            return 1
        print(text(value))
    elif a.command in ("range", "prefix"):
        got = store.range_scan(a.start, a.end, a.page, a.size) if a.command == "range" else store.prefix_scan(a.prefix, a.page, a.size)
        show(got.records, "key", "value")
        print(f"page {got.page_number} of {got.total_pages}, {got.total_count} records")
    elif a.command in ("iterate-range", "iterate-prefix"):
        it = store.range_iterator(a.start, a.end) if a.command == "iterate-range" else store.prefix_iterator(a.prefix)
        while it.next():
            print(f"{it.key}\t{text(it.value)}")
        it.stop()
    elif a.command == "versions":
        show(store.history(a.key).orderBy("version"), "version", "ts_ns", "tombstone", "value", "source")
    elif a.command == "flush":
        store.flush()
    elif a.command == "compact":
        store.compact(int(a.level))
    elif a.command == "runs":
        show(store.runs(), "name", "level", "rows", "min_key", "max_key")
    elif a.command == "validate":
        run = {r.name: r for r in store.manifest.runs}.get(a.run)
        wrong = store.validate(run) if run else None
        if wrong is None or wrong.limit(1).count():
            show(wrong, "idx", "key") if wrong else None
            return 1
    elif a.command == "checkpoint-create":
        store.create_checkpoint(a.name)
    elif a.command == "checkpoint-delete":
        store.delete_checkpoint(a.name)
    else:
        print(*store.checkpoints(), sep="\n")
    return 0


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(given)
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    config = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = Config.of(parse_sections(f.read()))
    try:
        with Store.open(spark, a.path, config) as store:
            if a.user is not None and not store.allow(a.user):
                print("no tokens are left", file=sys.stderr)
                return 1
            return run(store.open_checkpoint(a.checkpoint) if a.checkpoint else store, a)
    except (InvalidKey, FileExistsError, FileNotFoundError, PermissionError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
