"""Properties on random data: the chunked windows equal plain windows for any
chunk size, sparse days-held equals the dense calendar form, owners are
unique, ranks run 1..n."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, contract, wallet
from patronage import operators as ops
from patronage.operators.ordered import position_in_group, previous_in_group
from patronage.plans.params import Params
from patronage.sources.fixture import fixture_tables

SNAP = "2024-02-10 00:00:00"
NOW = "2024-03-01 00:00:00"


def random_transfers(seed: int, n: int = 300):
    """Random ERC-721 histories: each transfer moves a token from its owner."""
    rng = random.Random(seed)
    owners = {}
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for i in range(n):
        c = contract(rng.choice("ab"))
        tok = str(rng.randrange(12))
        to = wallet(rng.randrange(2, 15)) if rng.random() > 0.05 else wallet(0)
        frm = owners.get((c, tok), wallet(0))
        when = t0 + dt.timedelta(hours=rng.randrange(0, 24 * 45))
        rows.append((c, tok, when, frm, to, None, i, 0))
        owners[(c, tok)] = to
    # block order must follow time for a coherent history
    rows.sort(key=lambda r: (r[2], r[6]))
    return [r[:6] + (k, 0) for k, r in enumerate(rows)]


@pytest.mark.parametrize("chunk", [1, 3, 17, 10_000])
def test_previous_in_group_equals_lag(spark, chunk):
    rng = random.Random(chunk)
    data = [(rng.choice("xyz"), rng.randrange(3), i, f"v{i}") for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "g string, h int, o long, v string").withColumn(
        "ch", F.expr(f"o div {chunk}")
    )
    got = previous_in_group(df, ["g", "h"], "ch", ["o"], "v", "prev")
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g", "h").orderBy("o")))
    cols = ["g", "h", "o", "v", "prev"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


@pytest.mark.parametrize("chunk,descending", [(1, True), (5, False), (5, True), (1000, True)])
def test_position_in_group_equals_row_number(spark, chunk, descending):
    rng = random.Random(chunk)
    data = [(rng.choice("xy"), rng.randrange(40), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, o long, e long").withColumn("ch", F.expr(f"o div {chunk}"))
    order = [F.col("o").desc(), F.col("e").desc()] if descending else [F.col("o").asc(), F.col("e").asc()]
    got = position_in_group(df, ["g"], "ch", order, "pos", descending=descending)
    # ties on (o, e) are genuine duplicates: compare multisets of (g, o, e, pos)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    cols = ["g", "o", "e", "pos"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_fixture_small_chunks_equal_default(spark):
    big = fixture_tables(spark, SF_SMALL).transfers
    small = fixture_tables(spark, SF_SMALL, chunk_events=7).transfers
    assert sorted(big.collect()) == sorted(small.collect())


def dense_days_held(rows, snapshot: dt.datetime) -> dict:
    """The calendar x wallets form, in pandas (brute force)."""
    df = pd.DataFrame(rows, columns=["c", "tok", "ts", "frm", "to", "v", "bn", "ei"])
    df = df[df.ts <= snapshot]
    if df.empty:
        return {}
    df["day"] = df.ts.dt.normalize()
    start, end = df.day.min(), pd.Timestamp(snapshot).normalize()
    days = list(pd.date_range(start, end, freq="D"))
    wallets = sorted(set(df.to))
    change = {}
    for r in df.itertuples():
        change[(r.day, r.to)] = change.get((r.day, r.to), 0) + 1
        change[(r.day, r.frm)] = change.get((r.day, r.frm), 0) - 1
    out = {}
    for w in wallets:
        bal, n = 0, 0
        for d in days:
            bal += change.get((d, w), 0)
            n += bal > 0
        if n:
            out[w] = n
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sparse_days_held_equals_dense(spark, make_tables, seed):
    rows = random_transfers(seed)
    t = make_tables(transfers=rows)
    p = Params(addresses=[contract("a"), contract("b")], snapshot_time=SNAP, now=NOW)
    ct = ops.contract_transfers(t.transfers, p.addresses, p.snapshot())
    got = {r["wallet"]: r["days_held"] for r in ops.days_held(ct, p.snapshot()).collect()}
    assert got == dense_days_held(rows, dt.datetime.fromisoformat(SNAP))


@pytest.mark.parametrize("seed", [6, 7])
def test_owner_unique_and_rank_consistent(spark, make_tables, seed):
    rows = random_transfers(seed)
    t = make_tables(transfers=rows)
    p = Params(addresses=[contract("a"), contract("b")], snapshot_time=SNAP, now=NOW)
    ct = ops.contract_transfers(t.transfers, p.addresses, p.snapshot(), with_rank=True, chunk_blocks=5)
    tokens = ct.select("nft_contract_address", "token_id").distinct().count()
    owners = ops.current_owner(ct)
    assert owners.count() == tokens
    assert owners.agg(F.sum("num_held")).collect()[0][0] == tokens
    latest = ct.filter(F.col("rank_desc") == 1).select(
        F.col("to_address").alias("wallet"), "nft_contract_address", "token_id"
    )
    assert sorted(latest.collect()) == sorted(owners.drop("num_held").collect())
    per_token = ct.groupBy("nft_contract_address", "token_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank_desc").alias("mx"), F.countDistinct("rank_desc").alias("d")
    )
    assert per_token.filter((F.col("n") != F.col("mx")) | (F.col("n") != F.col("d"))).count() == 0


def test_address_rule_same_in_python_and_spark(spark):
    """Random messy address lists: the parameter parser and the Spark
    expression keep the same addresses."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from patronage.functions.addresses import parse_contract_list, valid_addresses

    hexchars = "0123456789abcdefABCDEF"
    part = st.one_of(
        st.text(alphabet=hexchars, min_size=39, max_size=41).map(lambda h: "0x" + h),
        st.text(alphabet=hexchars, min_size=40, max_size=40).map(lambda h: "0X" + h),
        st.text(alphabet=hexchars + "xg \n\t", max_size=45),
    )
    padded = st.tuples(st.sampled_from(["", " ", "  ", "\n", "\t"]), part, st.sampled_from(["", " ", "\n"])).map(
        lambda t: "".join(t)
    )
    texts = st.lists(padded, max_size=6).map(";".join)

    @settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(texts, min_size=1, max_size=8))
    def check(batch):
        df = spark.createDataFrame([(t,) for t in batch], "t string")
        got = [r[0] for r in df.select(valid_addresses(F.col("t"))).collect()]
        assert [sorted(g) for g in got] == [sorted(parse_contract_list(t)) for t in batch]

    check()


def hot_history(n_hot: int = 240, n_cold: int = 60):
    """One token takes most transfers and one wallet receives most of them."""
    rng = random.Random(99)
    rows, owners = [], {}
    t0 = dt.datetime(2024, 1, 1)
    plan = [("7", i) for i in range(n_hot)] + [(str(rng.randrange(1, 5)), n_hot + i) for i in range(n_cold)]
    rng.shuffle(plan)
    for k, (tok, _) in enumerate(plan):
        c = contract("a")
        to = wallet(3) if rng.random() < 0.5 else wallet(rng.randrange(4, 9))
        frm = owners.get((c, tok), wallet(0))
        owners[(c, tok)] = to
        rows.append((c, tok, t0 + dt.timedelta(hours=3 * k), frm, to, None, k, 0))
    return rows


@pytest.mark.parametrize("chunk_blocks", [7, 50])
def test_hot_token_and_wallet(spark, make_tables, chunk_blocks):
    rows = hot_history()
    t = make_tables(transfers=rows)
    p = Params(addresses=[contract("a")], snapshot_time=SNAP, now=NOW)
    ct = ops.contract_transfers(t.transfers, p.addresses, p.snapshot(), with_rank=True, chunk_blocks=chunk_blocks)
    plain = ops.contract_transfers(t.transfers, p.addresses, p.snapshot()).withColumn(
        "rank_desc",
        F.row_number()
        .over(Window.partitionBy("nft_contract_address", "token_id").orderBy(F.col("block_number").desc()))
        .cast("long"),
    )
    cols = ["token_id", "block_number", "rank_desc"]
    assert sorted(ct.select(cols).collect()) == sorted(plain.select(cols).collect())
    got = {r["wallet"]: r["days_held"] for r in ops.days_held(ct, p.snapshot()).collect()}
    snap = dt.datetime.fromisoformat(SNAP)
    assert got == dense_days_held(rows, snap)
    owner = {r["token_id"]: r["wallet"] for r in ops.current_owner(ct).collect()}
    last = {}
    for r in rows:
        if r[2] <= snap:
            last[r[1]] = r[4]
    assert owner == last


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_chunked_windows_with_null_keys_and_values(spark, chunk):
    """Null group keys form one group and null values are carried as values,
    exactly as in a plain window."""
    rng = random.Random(7 + chunk)
    data = [
        (rng.choice(["x", None]), rng.choice([1, None]), i, rng.choice([f"v{i}", None]))
        for i in rng.sample(range(300), 120)
    ]
    df = spark.createDataFrame(data, "g string, h int, o long, v string").withColumn(
        "ch", F.expr(f"o div {chunk}")
    )
    got = previous_in_group(df, ["g", "h"], "ch", ["o"], "v", "prev")
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g", "h").orderBy("o")))
    cols = ["g", "h", "o", "v", "prev"]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(got.select(cols).collect(), key=key) == sorted(want.select(cols).collect(), key=key)
    pos = position_in_group(df, ["g", "h"], "ch", [F.col("o").desc()], "pos", descending=True)
    want_pos = df.withColumn("pos", F.row_number().over(Window.partitionBy("g", "h").orderBy(F.col("o").desc())).cast("long"))
    cols = ["g", "h", "o", "pos"]
    assert sorted(pos.select(cols).collect(), key=key) == sorted(want_pos.select(cols).collect(), key=key)
