"""Price vectors against plain joins and brute force; names of a page."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import NAMES_SCHEMA, SALES_SCHEMA, TOKEN_PRICES_SCHEMA, contract, ts, wallet
from test_edges import _params, _sale, _sellers
from patronage import operators as ops
from patronage.operators import names as names_module
from patronage.operators.prices import SPAN_HOURS
from patronage.plans.leaderboards import fee_leaderboard

C1 = contract("a")
TOKENS = [contract(x) for x in "cdef"]
WETH = contract("9")


def price_table(seed, start="2023-12-20 00:00:00", hours=800):
    """Hours with gaps; null prices, WETH at 0 or missing, times that are not whole hours."""
    rng, begin = random.Random(seed), ts(start)
    rows = []
    for h in range(hours):
        at = begin + dt.timedelta(hours=h)
        for k, token in enumerate(TOKENS):
            if rng.random() < (0.9, 0.5, 0.05, 0.01)[k]:
                rows.append((at, token, "APE", None if rng.random() < 0.05 else rng.uniform(0.1, 9)))
        if rng.random() < 0.9:
            rows.append((at, WETH, "WETH", 0.0 if rng.random() < 0.05 else rng.uniform(1, 9)))
        if rng.random() < 0.1:
            rows.append((at + dt.timedelta(minutes=30), TOKENS[0], "APE", 77.0))
            rows.append((at, None, "NONE", 5.0) if rng.random() < 0.5 else (at, None, None, None))
    return rows


def sale_rows(seed, n=400, start="2023-12-19 12:00:00", hours=850):
    rng, begin = random.Random(seed), ts(start)
    currencies = [("ETH", "ETH"), ("WETH", WETH), (None, None), ("APE", None), ("OTHER", contract("7"))]
    currencies += [("APE", t) for t in TOKENS] + [(None, t) for t in TOKENS]
    rows = []
    for i in range(n):
        symbol, address = rng.choice(currencies)
        at = begin + dt.timedelta(seconds=rng.randrange(hours * 3600))
        rows.append(_sale(wallet(rng.randrange(9)), C1, str(at), i, symbol, address, rng.uniform(1, 5), 2.0, None if i % 7 == 0 else 0.1, 0.2))
    return rows


def brute_eth(sale, prices):
    at = sale["block_timestamp"].replace(minute=0, second=0, microsecond=0)
    if sale["currency_symbol"] in ("ETH", "WETH"):
        return sale["price"]
    token = next((p for h, t, _, p in prices if h == at and t is not None and t == sale["currency_address"]), None)
    weth = next((p for h, _, s, p in prices if h == at and s == "WETH"), None)
    return None if token is None or not weth else sale["price"] * (token / weth)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limits", [{}, {"small_bytes": 0}, {"small_bytes": 0, "broadcast_cells": 0}])
def test_vectors_price_as_rows_do(spark, seed, limits):
    prices, sales = price_table(seed), sale_rows(seed)
    s = spark.createDataFrame(sales, SALES_SCHEMA)
    p = spark.createDataFrame(prices, TOKEN_PRICES_SCHEMA)
    params = _params(snapshot_time="2024-01-25 00:00:00")
    got = ops.sale_eth_values(s, p, C1, params.snapshot(), **limits).collect()
    assert len(got) == sum(x["block_timestamp"] <= ts("2024-01-25 00:00:00") for x in s.collect())
    for row in got:
        want = brute_eth(row, prices)
        assert (row["price_eth"] is None) == (want is None)
        assert want is None or row["price_eth"] == pytest.approx(want, rel=1e-12)
        assert row["priced"] == (want is not None)
    plain = ops.sale_eth_values(s, p, C1, params.snapshot(), unique=False).collect()
    shown = lambda rows: {r["tx_hash"]: r["price_eth"] and f"{r['price_eth']:.9e}" for r in rows}
    assert shown(plain) == shown(got)


@pytest.mark.parametrize("start", ["2024-01-01 00:00:00", "1969-12-25 07:00:00", "2024-03-31 00:00:00"])
def test_vectors_hold_every_hour_once(spark, start):
    prices = price_table(5, start, 500)
    df = spark.createDataFrame(prices, TOKEN_PRICES_SCHEMA)
    vectors = ops.rate_vectors(ops.hourly_rates(df)).collect()
    got = {}
    for v in vectors:
        assert 0 <= v["first"] and v["first"] + len(v["rates"]) <= SPAN_HOURS
        for i, rate in enumerate(v["rates"]):
            hour = dt.datetime(1970, 1, 1) + dt.timedelta(hours=v["span"] * SPAN_HOURS + v["first"] + i)
            if rate is not None:
                got[hour, v["currency"]] = rate
    weth = {h: p for h, _, s, p in prices if s == "WETH"}
    want = {
        (h, t): p / weth[h] for h, t, _, p in prices if t and p is not None and weth.get(h) and (h.minute, h.second) == (0, 0)
    }
    assert got == pytest.approx(want, rel=1e-12)
    assert len({(v["currency"], v["span"]) for v in vectors}) == len(vectors)
    cells = sum(len(v["rates"]) for v in vectors)
    assert cells <= ops.count_cells(df) <= cells + SPAN_HOURS * 10  # rows of no token, of half hours


def test_empty_prices(spark, make_tables):
    t = make_tables(sales=[_sale(wallet(5), C1, "2024-01-10 01:00:00", 1, "APE", TOKENS[0], 1.0, 2.0, 0.1, 0.2)])
    for limits in ({}, {"small_bytes": -1}, {"small_bytes": -1, "broadcast_cells": -1}):
        rows = ops.sale_eth_values(t.sales, t.token_prices, C1, _params().snapshot(), **limits).collect()
        assert [(r["price_eth"], r["priced"]) for r in rows] == [(None, False)]


@pytest.mark.parametrize("limits", [{}, {"small_bytes": -1, "broadcast_cells": -1}])
def test_prices_that_are_not_unique_fail(make_tables, limits):
    hour = ts("2024-01-10 01:00:00")
    sale = [_sale(wallet(5), C1, "2024-01-10 01:30:00", 1, "APE", TOKENS[0], 1.0, 2.0, 0.1, 0.2)]
    several = {
        "hourly token prices: key .hour, token_address. is not unique: 2024-01-10 01:00:00, 0xc": [(hour, TOKENS[0], "APE", 2.0)] * 2,
        "WETH prices: key .hour. is not unique: 2024-01-10 01:00:00": [(hour, WETH, "WETH", 2.0), (hour, TOKENS[1], "WETH", None)],
    }
    for message, prices in several.items():
        t = make_tables(sales=sale, prices=[(hour, TOKENS[0], "APE", 1.0) if "WETH" in message else (hour, WETH, "WETH", 1.0), *prices])
        with pytest.raises(Exception, match=message):
            ops.sale_eth_values(t.sales, t.token_prices, C1, _params().snapshot(), **limits).collect()
    later = [(ts("2024-01-25 00:30:00"), TOKENS[0], "APE", 2.0)] * 2 + [(ts("2024-02-25 00:00:00"), TOKENS[0], "APE", 2.0)] * 2
    t = make_tables(sales=sale, prices=later)  # no hour that the snapshot covers
    assert ops.sale_eth_values(t.sales, t.token_prices, C1, _params().snapshot(), **limits).count() == 1


def test_one_price_of_a_busy_hour_lies_in_one_group(spark):
    """The price of a token a third of all rows repeat is one row before a vector is made."""
    many = spark.range(3000).selectExpr("TIMESTAMP_NTZ'2024-01-10 01:00:00' AS hour", "'0xc' AS token_address", "'APE' AS symbol", "1.0D AS price")
    rates = ops.hourly_rates(many)
    with pytest.raises(Exception, match="hourly token prices"):
        rates.collect()
    assert rates.drop("rate").count() == 1


@pytest.mark.parametrize("small", [{}, {"small_bytes": -1}])
@pytest.mark.parametrize("options", [{}, {"smallest_name": True}, {"unique": False}])
def test_names_of_a_page_are_those_of_the_join(spark, options, small):
    rng = random.Random(3)
    several = [] if not options else [(wallet(rng.randrange(40)), f"n{i % 50}", "Y") for i in range(200)]
    names = [(wallet(i), f"own{i}", "Y" if i % 3 else "N") for i in range(60)] + several + [(None, "nobody", "Y"), (wallet(3), None, "N")]
    n = spark.createDataFrame(names, NAMES_SCHEMA)
    for size in (1, 7, 100):
        page = spark.range(size).selectExpr("concat('0x', lpad(CAST(id AS STRING), 40, '0')) AS wallet", "id AS score")
        got = ops.with_page_names(page, n, 1000, **options, **small)
        want = ops.with_display_name(page, n, smallest_name=options.get("smallest_name", False))
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = ops.with_page_names(page.limit(0), n, 10, **options, **small)
    assert empty.collect() == []


@pytest.mark.parametrize("small_bytes", [10 << 20, -1])
def test_a_wallet_with_very_many_names(make_tables, spark, monkeypatch, small_bytes):
    """Of a large table, no more of its names than the page can show are broadcast."""
    monkeypatch.setattr(names_module, "SMALL_BYTES", small_bytes)
    t = make_tables(sales=_sellers(3))
    names = spark.range(5000).selectExpr(f"'{wallet(13)}' AS owner", "lpad(CAST(id AS STRING), 5, '0') AS ens_name", "'Y' AS ens_set")
    many = type(t)(t.transfers, t.sales, t.token_prices, names)
    rows = fee_leaderboard(many, _params(validate=False)).collect()
    assert [r["ens_or_wallet"] for r in rows] == [f"{i:05d}.eth" for i in range(10)]
    with pytest.raises(Exception, match="names in use"):
        fee_leaderboard(many, _params()).collect()
    first = fee_leaderboard(many, _params(smallest_name=True)).collect()
    assert [r["ens_or_wallet"] for r in first] == ["00000.eth", wallet(12), wallet(11)]


def test_both_counts_from_one_pass(make_tables):
    t = make_tables(sales=[_sale(wallet(5 + i % 2), C1, "2024-01-10 01:00:00", i // 2, "ETH", "ETH", 1.0, 2.0, 0.1, 0.2) for i in range(40)])
    snap = _params().snapshot()
    both = ops.sales_by_seller(t.sales, t.token_prices, C1, snap, both_counts=True)
    assert {r["wallet"]: r["num_txns_exact"] for r in both.collect()} == {wallet(5): 20, wallet(6): 20}
    assert all(abs(r["num_txns"] - 20) <= 5 for r in both.collect())
    assert str(both._jdf.queryExecution().optimizedPlan().toString()).count("LogicalRDD") <= 2
