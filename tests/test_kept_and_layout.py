"""States that are kept up by day against the full computation on random histories;
transfers stored in buckets by token."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL, TRANSFERS_SCHEMA, contract, wallet
from test_plans import plan_of
from test_properties import NOW, SNAP, random_transfers
from patronage import operators as ops
from patronage.plans.params import Params
from patronage.sources import buckets_for, read_clustered, write_clustered

C = ";".join(contract(x) for x in "ab")
PARAMS = Params(addresses=C, snapshot_time=SNAP, now=NOW)


def history(seed, n=300):
    """Random ERC-721 moves, and ERC-1155 ones between a few wallets, null ones among them."""
    rng = random.Random(seed)
    rows = random_transfers(seed, n)
    for i in range(n // 2):
        when = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 45))
        frm, to = (rng.choice([wallet(rng.randrange(5)), None]) if rng.random() < 0.1 else wallet(rng.randrange(5)) for _ in "ab")
        rows.append((contract(rng.choice("ab")), str(rng.randrange(20, 24)), when, frm, to, rng.randrange(1, 9), 10_000 + i, 0))
    return rows


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("cuts", [[20], [5, 20, 21], []])
def test_days_added_up_are_the_whole(spark, tmp_path, seed, cuts):
    snap = PARAMS.snapshot()
    ct = ops.contract_transfers(spark.createDataFrame(history(seed), TRANSFERS_SCHEMA), C, snap, include_erc1155=True)
    single = ct.filter(~F.col("is_erc1155"))
    edges = [dt.date(2024, 1, 1), *[dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in cuts], dt.date(2024, 3, 1)]
    kinds = {
        "owners": (single, ops.owner_state, ops.merge_owners),
        "latest": (ct, lambda x: ops.owner_state(x, kinds_together=True), ops.merge_owners),
        "balances": (ct, ops.balance_state, ops.merge_balances),
        "changes": (single, ops.change_state, ops.merge_changes),
    }
    state = {}
    for kind, (rows, build, merge) in kinds.items():
        for k, (low, high) in enumerate(zip(edges, edges[1:])):
            path = str(tmp_path / f"{kind}{k}")
            new = build(rows.filter((F.col("day") >= F.lit(low)) & (F.col("day") < F.lit(high))))
            (merge(spark.read.parquet(state[kind]).unionByName(new)) if kind in state else new).write.parquet(path)
            state[kind] = path
    held = {kind: spark.read.parquet(path) for kind, path in state.items()}
    assert rows_of(ops.owners_of(held["owners"])) == rows_of(ops.current_owner(ct))
    assert rows_of(ops.owners_of(held["latest"])) == rows_of(ops.current_owner(ct, kinds_together=True))
    assert rows_of(ops.balances_of(held["balances"])) == rows_of(ops.token_balances(ct))
    assert rows_of(ops.changes_of(held["changes"])) == rows_of(ops.daily_change(single))
    assert rows_of(ops.days_held_of(held["changes"], snap)) == rows_of(ops.days_held(single, snap))


def test_a_balance_that_comes_back(spark):
    """0 and less are kept in the state: a later receipt counts from there."""
    move = lambda frm, to, n, day, i: (contract("a"), "1", dt.datetime(2024, 1, day), wallet(frm), wallet(to), n, i, 0)
    rows = [move(5, 6, 3, 1, 1), move(7, 5, 4, 2, 2)]
    ct = ops.contract_transfers(spark.createDataFrame(rows, TRANSFERS_SCHEMA), C, PARAMS.snapshot(), include_erc1155=True)
    early, late = (ops.balance_state(ct.filter(F.dayofmonth("day") == d)) for d in (1, 2))
    assert {(r["wallet"], r["moved"]) for r in early.collect()} == {(wallet(5), -3), (wallet(6), 3)}
    merged = ops.balances_of(ops.merge_balances(early.union(late)))
    assert {(r["wallet"], r["num_held"]) for r in merged.collect()} == {(wallet(5), 1), (wallet(6), 3)}


def test_empty_states(spark, make_tables):
    ct = ops.contract_transfers(make_tables().transfers, C, PARAMS.snapshot(), include_erc1155=True)
    assert ops.owners_of(ops.owner_state(ct)).count() == 0
    assert ops.balances_of(ops.balance_state(ct)).count() == 0
    assert ops.days_held_of(ops.change_state(ct), PARAMS.snapshot()).count() == 0


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "transfers")
    transfers = spark.createDataFrame(history(9, 600), TRANSFERS_SCHEMA)
    write_clustered(transfers, "transfers_by_token", 8, path=path)
    yield transfers, read_clustered(spark, "transfers_by_token")
    spark.sql("DROP TABLE transfers_by_token")


PLANS = {
    "owner": lambda t: ops.current_owner(ops.contract_transfers(t, C, PARAMS.snapshot())),
    "rank_desc": lambda t: ops.contract_transfers(t, C, PARAMS.snapshot(), with_rank=True, chunk_blocks=50),
    "rank_asc": lambda t: ops.contract_transfers(t, C, PARAMS.snapshot(), with_rank_asc=True, chunk_blocks=50),
    "both": lambda t: ops.contract_transfers(t, C, PARAMS.snapshot(), with_rank=True, with_rank_asc=True, chunk_blocks=50),
    "state": lambda t: ops.owner_state(ops.contract_transfers(t, C, PARAMS.snapshot(), include_erc1155=True)),
}


@pytest.mark.parametrize("name", PLANS)
def test_clustered_transfers_are_not_exchanged(clustered, name):
    stored, table = clustered
    df = PLANS[name](table)
    assert "Exchange" not in plan_of(df)
    assert "Exchange" in plan_of(PLANS[name](stored))
    assert rows_of(df) == rows_of(PLANS[name](stored)) and df.count()


def test_clustered_filters_reach_the_scan(spark, clustered):
    held = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(PLANS["owner"](clustered[1]))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", held)
    assert "In(nft_address, [" in plan and "LessThanOrEqual(block_timestamp" in plan and "Bucketed: true" in plan


def test_a_bucket_is_one_sorted_file(spark, clustered):
    rows = clustered[1].select("tokenid", "nft_address", "block_number", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    files = {r["file"] for r in rows}
    assert 1 < len(files) <= 8
    tokens = {}
    for f in files:
        found = [(r["tokenid"], r["nft_address"], r["block_number"]) for r in sorted((r for r in rows if r["file"] == f), key=lambda r: r["at"])]
        assert found == sorted(found)
        for t in {x[:2] for x in found}:
            assert tokens.setdefault(t, f) == f


def test_bucket_numbers():
    assert buckets_for(0) == 8 and buckets_for(100 * 10**12) == -(-(100 * 10**12) // (256 << 20))


def test_fixture_days_add_up(spark):
    queries = E.queries()
    for kept, whole in (("all_holdings_kept_up", "all_holdings_both"), ("days_held_kept_up", "days_held")):
        assert rows_of(queries[kept](spark, SF_SMALL)) == rows_of(queries[whole](spark, SF_SMALL))
