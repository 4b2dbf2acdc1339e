"""Sales per seller, with amounts converted to ETH at the hourly price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.pricing import ETH_REFERENCE_SYMBOL, eth_value, is_native_eth
from patronage.functions.timefuncs import trunc_ntz
from patronage.operators.contracts import Contracts, in_contracts
from patronage.operators.prices import prices_in_scope, span_and_place, vectors_for_join

#: Keys over which the sales that need no price are spread in the price join.
SPREAD = 1024


def sales_in_scope(
    sales: DataFrame, contracts: Contracts, snapshot: Column, day_column: str | None = None
) -> DataFrame:
    """Sales of the chosen contracts up to the snapshot, with a USD price and a
    fee that is not negative (a missing fee counts as 0). ``day_column``: a date
    partition column of ``sales``, so that folders of later days are not read."""
    cond = (
        (F.col("block_timestamp") <= snapshot)
        & (F.col("price_usd") > 0)
        & (F.coalesce(F.col("creator_fee_usd"), F.lit(0.0)) >= 0)
    )
    if day_column and day_column in sales.columns:
        cond = cond & (F.col(day_column).cast("date") <= snapshot.cast("date"))
    return in_contracts(sales, "nft_address", contracts, also=cond)


def sale_eth_values(
    sales: DataFrame,
    token_prices: DataFrame,
    contracts: Contracts,
    snapshot: Column,
    unique: bool = True,
    day_column: str | None = None,
    **limits: int,
) -> DataFrame:
    """One row per sale in scope with ``price_eth`` and ``creator_fee_eth``.

    One scan of the sales, one of the prices. The prices become vectors by currency
    (see ``prices.py``); where these are small, or are counted to be within a limit,
    they are broadcast and no sale is shuffled. Beyond that the sales are dealt by
    currency and span: Spark splits a busy currency, and ETH and WETH sales, which
    need no price, join under keys that no currency has, spread over SPREAD values.
    ``limits``: ``small_bytes`` and ``broadcast_cells`` of ``vectors_for_join``.

    A price key that is not unique fails the query; with ``unique`` false it
    multiplies the sales instead, as a plain join with the price table does.
    """
    scoped = sales_in_scope(sales, contracts, snapshot, day_column)
    symbol = F.col("currency_symbol")
    native = is_native_eth(symbol)
    kept = [F.col("seller_address").alias("wallet"), *[F.col(c) for c in scoped.columns if c != "seller_address"]]
    if unique:
        vectors, small = vectors_for_join(token_prices, snapshot, day_column, **limits)
        priced = _with_rate(scoped.select(*kept), vectors, native, spread=not small)
    else:
        priced = _with_any_rate(scoped.select(*kept), prices_in_scope(token_prices, snapshot, day_column), native)
    rate = F.col("_rate")
    return priced.select(
        *[F.col(c) for c in priced.columns if c != "_rate"],
        eth_value(F.col("price"), symbol, rate).alias("price_eth"),
        eth_value(F.col("creator_fee"), symbol, rate).alias("creator_fee_eth"),
        (native | rate.isNotNull()).alias("priced"),
    )


def _spread_key(native: Column, spread: bool) -> Column:
    """The currency that a sale joins prices on; sales without one have none, or a
    key of their own (a space: no address has one) if they must not gather."""
    none = F.lit(None).cast("string")
    if spread:
        none = F.concat(F.lit("no currency "), F.pmod(F.xxhash64("tx_hash"), F.lit(SPREAD)).cast("string"))
    return F.when(native | F.col("currency_address").isNull(), none).otherwise(F.col("currency_address"))


def _with_rate(rows: DataFrame, vectors: DataFrame, native: Column, spread: bool) -> DataFrame:
    """``rows`` with ``_rate``, the ETH for a unit of their currency in their hour."""
    span, place = span_and_place("block_timestamp")
    keyed = rows.withColumns({"_currency": _spread_key(native, spread), "_span": F.expr(span)})
    joined = keyed.join(vectors.toDF("_currency", "_span", "_first", "_rates"), ["_currency", "_span"], "left")
    return joined.select(*rows.columns, F.expr(f"get(_rates, {place} - _first) AS _rate"))


def _with_any_rate(rows: DataFrame, prices: DataFrame, native: Column) -> DataFrame:
    """As ``_with_rate``, for price tables whose keys need not be unique: a sale has a
    row for every price of its currency and hour, and every WETH price of the hour."""
    tokens = prices.select(F.col("hour").alias("_hour"), F.col("token_address").alias("_currency"), F.col("price").alias("_token"))
    weth = prices.filter(F.col("symbol") == ETH_REFERENCE_SYMBOL).select(F.col("hour").alias("_hour"), F.col("price").alias("_weth"))
    keyed = rows.withColumns({"_hour": trunc_ntz("hour", F.col("block_timestamp")), "_currency": _spread_key(native, True)})
    joined = keyed.join(tokens, ["_hour", "_currency"], "left").join(weth, "_hour", "left")
    return joined.select(*rows.columns, F.try_divide("_token", "_weth").alias("_rate"))


def sales_by_seller(
    sales: DataFrame,
    token_prices: DataFrame,
    contracts: Contracts,
    snapshot: Column,
    exact_txns: bool = False,
    unique: bool = True,
    day_column: str | None = None,
    both_counts: bool = False,
) -> DataFrame:
    """Per seller: vol_eth, creator_fee_eth, vol_usd, creator_fee_usd, num_txns.

    ``num_txns`` is approximate (HyperLogLog++) unless ``exact_txns``; with
    ``both_counts`` the exact one stands beside it (``num_txns_exact``), from the
    same pass over the sales.
    """
    rows = sale_eth_values(sales, token_prices, contracts, snapshot, unique, day_column)
    exact, approximate = F.countDistinct("tx_hash"), F.approx_count_distinct("tx_hash")
    counts = [(exact if exact_txns else approximate).alias("num_txns")]
    if both_counts:
        counts.append(exact.alias("num_txns_exact"))
    return rows.groupBy("wallet").agg(
        F.sum("price_eth").alias("vol_eth"),
        F.sum("creator_fee_eth").alias("creator_fee_eth"),
        F.sum("price_usd").alias("vol_usd"),
        F.sum("creator_fee_usd").alias("creator_fee_usd"),
        *counts,
    )


def seller_days(
    sales: DataFrame,
    token_prices: DataFrame,
    contracts: Contracts,
    snapshot: Column,
    unique: bool = True,
    day_column: str | None = None,
    log_size: int = 12,
) -> DataFrame:
    """Per seller and day, what ``merge_seller_days`` adds up over any days: the sums
    of ``sales_by_seller`` and a sketch of the day's transactions (HyperLogLog,
    ``2 ** log_size`` registers; at most 4 KB for 12).

    Written once a day, a later leaderboard reads these rows instead of the sales.
    """
    rows = sale_eth_values(sales, token_prices, contracts, snapshot, unique, day_column)
    return rows.groupBy("wallet", F.col("block_timestamp").cast("date").alias("day")).agg(
        F.sum("price_eth").alias("vol_eth"),
        F.sum("creator_fee_eth").alias("creator_fee_eth"),
        F.sum("price_usd").alias("vol_usd"),
        F.sum("creator_fee_usd").alias("creator_fee_usd"),
        F.hll_sketch_agg(F.col("tx_hash").cast("string"), F.lit(log_size)).alias("txns"),
    )


def merge_seller_days(days: DataFrame) -> DataFrame:
    """``sales_by_seller`` (``num_txns`` estimated) from the rows of ``seller_days``, of
    one table or of a union of several: a transaction that several days hold counts
    once."""
    sums = ["vol_eth", "creator_fee_eth", "vol_usd", "creator_fee_usd"]
    return days.groupBy("wallet").agg(
        *[F.sum(c).alias(c) for c in sums], F.hll_sketch_estimate(F.hll_union_agg("txns")).alias("num_txns")
    )


def unpriced_sales(
    sales: DataFrame, token_prices: DataFrame, contracts: Contracts, snapshot: Column
) -> DataFrame:
    """Per currency symbol: sales in scope, and those whose ETH value is unknown
    because a token or WETH price is missing or the WETH price is 0 (they drop
    out of ETH sums)."""
    rows = sale_eth_values(sales, token_prices, contracts, snapshot)
    return rows.groupBy("currency_symbol").agg(
        F.count(F.lit(1)).alias("num_sales"),
        F.sum(F.when(~F.col("priced"), 1).otherwise(0)).cast("long").alias("num_unpriced"),
    )
