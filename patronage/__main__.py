"""Command line: print a leaderboard for chosen collections.

    python -m patronage holders --brand Memeland --tables /data/nft
    python -m patronage fees --addresses "0xaaa...;0xbbb..." --fixture /root/testdata/sf0.01 \\
        --snapshot "2024-01-25" --now "2024-02-01 10:30"

``--tables`` names a folder with Parquet tables ``transfers``, ``sales``,
``token_prices`` and ``names``; ``--fixture`` derives them from the test
tables instead. Collections are chosen by brand / collection name from the
catalog, or typed as ';'-separated addresses (the two ways the dashboard
offers).
"""

from __future__ import annotations

import argparse
import sys

from patronage.plans.leaderboards import fee_leaderboard, holder_leaderboard, holding_period_leaderboard
from patronage.plans.params import DEFAULT_PAGE_SIZE, DEFAULT_SNAPSHOT, Params

BOARDS = {
    "fees": fee_leaderboard,
    "holders": holder_leaderboard,
    "holding": holding_period_leaderboard,
}


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="patronage", description=__doc__.split("\n\n")[0])
    p.add_argument("board", choices=sorted(BOARDS))
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with transfers/, sales/, token_prices/, names/ (Parquet)")
    src.add_argument("--fixture", help="folder with the test tables (events, customer)")
    p.add_argument("--addresses", help="';'-separated contract addresses")
    p.add_argument("--brand", action="append", default=[], help="catalog brand (repeatable)")
    p.add_argument("--collection", action="append", default=[], help="catalog collection name (repeatable)")
    p.add_argument("--snapshot", default=DEFAULT_SNAPSHOT)
    p.add_argument("--now", default=None, help="fixed current time (default: now)")
    p.add_argument("--page-size", type=int, default=DEFAULT_PAGE_SIZE)
    p.add_argument("--day-column", help="date partition column of the stored tables: later folders are not read")
    p.add_argument("--allow-duplicates", action="store_true", help="do not fail on duplicate price or name keys")
    return p


def run(args: argparse.Namespace, spark) -> "DataFrame":  # noqa: F821
    from patronage.sources.catalog import choose_addresses
    from patronage.sources.fixture import fixture_tables
    from patronage.sources.tables import load_tables

    if args.tables:
        names = ["transfers", "sales", "token_prices", "names"]
        keep = [args.day_column] if args.day_column else []
        tables = load_tables(spark, {n: f"{args.tables}/{n}" for n in names}, keep=keep)
    else:
        tables = fixture_tables(spark, args.fixture)
    if args.addresses:
        addresses = args.addresses
    else:
        addresses = choose_addresses(args.brand, args.collection)
    params = Params(
        addresses=addresses,
        snapshot_time=args.snapshot,
        now=args.now,
        page_size=args.page_size,
        validate=not args.allow_duplicates,
        day_column=args.day_column,
    )
    return BOARDS[args.board](tables, params)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from patronage.session import configure

    from pyspark.sql import SparkSession

    # the master and the resources are the submitter's; only settings left unset are filled in
    spark = configure(SparkSession.builder.appName("patronage").getOrCreate())
    board = run(args, spark)
    shown = board.select(*[board[f.name].alias(f.metadata.get("label", f.name)) for f in board.schema.fields])
    shown.show(args.page_size, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
