"""Command line.

    python -m prefixspark repl FOLDER [--arena 64MB]      reads commands from standard input
    python -m prefixspark storm                           upserts by many workers, audited
    python -m prefixspark crash [--cycles 400]            logs cut at different places, recovered and compared
    python -m prefixspark pressure [--arena 4MB]          an arena and a slab pool filled to the brim
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import parse_size
from .operators import audit
from .session import Session, run_script


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="prefixspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    repl = commands.add_parser("repl")
    repl.add_argument("folder")
    repl.add_argument("--arena", default="64MB")
    storm = commands.add_parser("storm")
    for name, value in (("--workers", 16), ("--attempts", 1_000_000), ("--keyspace", 65_536)):
        storm.add_argument(name, type=int, default=value)
    crash = commands.add_parser("crash")
    for name, value in (("--cycles", 1), ("--transactions", 512), ("--survivors", 400)):
        crash.add_argument(name, type=int, default=value)
    commands.add_parser("pressure").add_argument("--arena", default="4MB")
    return parser.parse_args(argv)


def size_of(spark: SparkSession, text: str) -> int:
    n = spark.range(1).select(parse_size(F.lit(text))).first()[0]
    if n is None:
        raise SystemExit(f"not a size: {text}")
    return n


def run(spark: SparkSession, args: argparse.Namespace, lines: list[str]) -> list[str]:
    """What the command prints."""
    if args.command == "repl":
        return run_script(Session(spark, args.folder, arena_bytes=size_of(spark, args.arena)), lines)
    if args.command == "storm":
        ops = audit.storm_ops(spark, args.workers, args.attempts, args.keyspace)
        row, met = audit.storm_audit(spark, args.workers, args.attempts, args.keyspace).first(), audit.storm_contention(ops).first()
        return [f"verified {row['verified']}, lost {row['lost']}, contended {met['contended']} of {met['attempts']} ({met['rate']:.2f}%)"]
    if args.command == "crash":
        one = audit.crash_cycle(spark, args.transactions, args.survivors).select(F.lit(0).alias("cycle"), "*")
        rows = (one if args.cycles <= 1 else audit.crash_cycles(spark, args.cycles, args.transactions)).orderBy("cycle").collect()
        return [f"cycle {r['cycle']}: {r['replayed']} of {r['written']} replayed, {r['survived']} survived, consistent={r['consistent']}, high water {r['high_water']}, log {r['log_bytes']} bytes" for r in rows]
    r = audit.pressure(spark, size_of(spark, args.arena)).first()
    return [f"inserted {r['inserted']}, frontier {r['frontier']} of {r['capacity']} bytes, verified {r['verified']}, slots {r['allocated']}, recycled {r['recycled']}"]


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("prefixspark").getOrCreate()
    for said in run(spark, args, sys.stdin.read().splitlines() if args.command == "repl" else []):
        print(said)


if __name__ == "__main__":
    main()
