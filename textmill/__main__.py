"""Command line: reduce files, look texts up in the restore store, report and clear it.

    python -m textmill reduce IN OUT [--store DIR] [--profile NAME] [--dry-run]
    python -m textmill retrieve HASH --store DIR
    python -m textmill stats --store DIR
    python -m textmill clear --store DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import PROFILES, profile
from .operators.pipeline import reduce_all
from .sources import store as stores
from .sources.files import read_texts, write_companions
from .sources.scratch import clear


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textmill")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("reduce", help="reduce text files")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--store")
    one.add_argument("--profile", choices=list(PROFILES), default="balanced")
    one.add_argument("--dry-run", action="store_true")
    for name in ("retrieve", "stats", "clear"):
        one = commands.add_parser(name)
        if name == "retrieve":
            one.add_argument("hash")
        one.add_argument("--store", required=True)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0, or 1 if there is nothing under the hash asked for."""
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("textmill").getOrCreate()
    if given.command == "reduce":
        cfg = profile(given.profile)
        texts = read_texts(spark, given.source)
        done = reduce_all(texts, cfg, keep=("path", "text"))
        out = write_companions(done.drop("text"), given.target, given.dry_run)
        if given.store and not given.dry_run:
            stores.Store(spark, given.store, cfg).put(done.where("was_compressed"))
        saved = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("chars_saved"), F.lit(0)).alias("saved")).first()
        clear(spark)
        print(f"{saved['n']} texts reduced, {saved['saved']:,} characters saved")
        return 0
    store = stores.Store(spark, given.store)
    if given.command == "retrieve":
        row = store.get(spark.createDataFrame([(given.hash,)], "hash string")).first()
        if row is None or row["original"] is None:
            print(f"nothing is stored under {given.hash}", file=sys.stderr)
            return 1
        print(row["original"])
    elif given.command == "stats":
        row = stores.stats(store.read()).first()
        print(f"{row['entries']} entries, {row['total_bytes']:,} bytes, at most {row['max_entries']} entries, in {given.store}")
    else:
        store.clear()
    return 0


if __name__ == "__main__":
    sys.exit(main())
