"""The four NFT tables derived from the driver's test tables.

The test data has no NFT tables; they are derived from ``events`` (transfers,
sales, hourly prices) and ``customer`` (names). W(n) is the wallet of user n,
A(event_type) the contract of an event type. Each event is one transfer and
one sale. The previous receiver of a token becomes the sender of the next
ERC-721 transfer (computed with the chunked window of
:mod:`patronage.operators.ordered`, so one hot token never lands in one task).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.timefuncs import trunc_ntz
from patronage.operators.ordered import previous_in_group
from patronage.sources.tables import Tables, conform

# Fixed values of the test-table mapping.
# Contract letter per event type: A(t) = '0x' + letter * 40.
CONTRACT_LETTER = {"view": "a", "purchase": "b", "click": "c", "error": "d", "signup": "e"}
# Price symbol per event type; others use their contract letter.
PRICE_SYMBOL = {"view": "WETH", "error": "APE"}
# Sale currency by event_id % 4: (symbol, currency address); the address of
# WETH is A(view), of APE is A(error); 3 means no currency.
CURRENCY_BY_MOD4 = {0: ("ETH", "ETH"), 1: ("WETH", "view"), 2: ("APE", "error")}
# ERC-1155 rows: event_id % 10 == 0, value event_id % 7 + 1.
ERC1155_EVERY = 10
ERC1155_MOD = 7
# Nulls and odd values in sales.
NULL_FEE_EVERY = 9
ZERO_USD_EVERY = 13
NEGATIVE_FEE_USD_EVERY = 17
FEE_SHARE = 0.05
FEE_USD_SHARE = 0.1
USD_PER_UNIT = 2
# Names in use: account balance above this.
NAME_IN_USE_BALANCE = 2000
# Contracts and times the tests and the registered queries use.
TEST_CONTRACT_TYPES = ("view", "purchase")
TEST_SNAPSHOT = "2024-01-25 00:00:00"
TEST_NOW = "2024-02-01 10:30:00"

# Rows per (token, chunk) of the sender window: bounds one task's sort.
DEFAULT_CHUNK_EVENTS = 1_000_000


def wallet_of(n: Column) -> Column:
    """W(n) = '0x' || lpad(n, 40, '0')."""
    return F.concat(F.lit("0x"), F.lpad(n.cast("string"), 40, "0"))


def contract_address(letter: str) -> str:
    return "0x" + letter * 40


def contract_of(event_type: Column) -> Column:
    """A(event_type); null for an unknown type."""
    expr = None
    for kind, letter in CONTRACT_LETTER.items():
        expr = (F.when if expr is None else expr.when)(event_type == kind, F.lit(contract_address(letter)))
    return expr


def fixture_contracts() -> list[str]:
    return [contract_address(CONTRACT_LETTER[t]) for t in TEST_CONTRACT_TYPES]


def transfers_from_events(events: DataFrame, chunk_events: int = DEFAULT_CHUNK_EVENTS) -> DataFrame:
    """ERC-721 rows (sender = previous receiver of the token) united with
    ERC-1155 rows (sender = the zero address).

    The two kinds are separate branches of a union whose ``erc1155_value`` is
    a literal null in the ERC-721 branch, so Catalyst drops the whole branch
    (and its window) for queries that keep ERC-1155 rows only.
    """
    is1155 = F.col("event_id") % ERC1155_EVERY == 0
    common = [
        contract_of(F.col("event_type")).alias("nft_address"),
        F.regexp_replace(F.col("props"), "[^0-9]", "").alias("tokenid"),
        F.col("ts").alias("block_timestamp"),
        wallet_of(F.col("user_id")).alias("nft_to_address"),
        F.col("event_id").alias("block_number"),
        F.lit(0).alias("event_index"),
    ]
    # The sender window runs on compact columns (event kind, token, user id,
    # event id); the 42-character addresses are built after it, since
    # W(previous user) is the previous W(user). Unknown event types share one
    # null kind, as they share one null contract. A filter on nft_address only
    # refers to the kind, a window key, so it still runs below the window.
    kind = F.when(F.col("event_type").isin(*CONTRACT_LETTER), F.col("event_type")).alias("_kind")
    erc721 = events.filter(~is1155).select(
        kind,
        F.regexp_replace(F.col("props"), "[^0-9]", "").alias("tokenid"),
        "ts",
        "user_id",
        "event_id",
        F.expr(f"event_id div {int(chunk_events)}").alias("_chunk"),
    )
    erc721 = previous_in_group(
        erc721,
        keys=["tokenid", "_kind"],  # varied key first, see ownership.TOKEN_SORT_KEYS
        chunk="_chunk",
        order=["event_id"],
        value="user_id",
        out="_prev_user",
    ).select(
        contract_of(F.col("_kind")).alias("nft_address"),
        "tokenid",
        F.col("ts").alias("block_timestamp"),
        wallet_of(F.col("user_id")).alias("nft_to_address"),
        F.col("event_id").alias("block_number"),
        F.lit(0).alias("event_index"),
        # null literal above the window: a filter on it folds here
        F.lit(None).cast("long").alias("erc1155_value"),
        F.coalesce(wallet_of(F.col("_prev_user")), wallet_of(F.lit(0))).alias("nft_from_address"),
    )
    erc1155 = events.filter(is1155).select(
        *common,
        # never null on these rows (event_id is set); saying so lets Catalyst
        # drop this branch for queries that keep ERC-721 rows only
        F.coalesce(F.col("event_id") % ERC1155_MOD + 1, F.lit(1)).cast("long").alias("erc1155_value"),
        wallet_of(F.lit(0)).alias("nft_from_address"),
    )
    return erc721.unionByName(erc1155)


def sales_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    value = F.col("value")
    symbol = None
    address = None
    for mod, (sym, addr) in CURRENCY_BY_MOD4.items():
        addr_value = addr if addr == "ETH" else contract_address(CONTRACT_LETTER[addr])
        symbol = (F.when if symbol is None else symbol.when)(eid % 4 == mod, F.lit(sym))
        address = (F.when if address is None else address.when)(eid % 4 == mod, F.lit(addr_value))
    return events.select(
        wallet_of(F.col("user_id")).alias("seller_address"),
        contract_of(F.col("event_type")).alias("nft_address"),
        F.col("ts").alias("block_timestamp"),
        F.expr("event_id div 2").alias("tx_hash"),
        symbol.alias("currency_symbol"),
        address.alias("currency_address"),
        value.alias("price"),
        F.when(eid % ZERO_USD_EVERY == 0, F.lit(0.0)).otherwise(value * USD_PER_UNIT).alias("price_usd"),
        F.when(eid % NULL_FEE_EVERY == 0, F.lit(None)).otherwise(value * FEE_SHARE).alias("creator_fee"),
        F.when(eid % NULL_FEE_EVERY == 0, F.lit(None))
        .when(eid % NEGATIVE_FEE_USD_EVERY == 0, F.lit(-1.0))
        .otherwise(value * FEE_USD_SHARE)
        .alias("creator_fee_usd"),
    )


def token_prices_from_events(events: DataFrame) -> DataFrame:
    """Hourly average value per contract. Grouped by (hour, event kind);
    the contract and symbol, both functions of the kind, are built on the
    aggregated rows (unknown kinds form one null group, as their null
    contract would)."""
    et = F.col("event_type")
    hourly = events.groupBy(
        trunc_ntz("hour", F.col("ts")).alias("hour"),
        F.when(et.isin(*CONTRACT_LETTER), et).alias("_kind"),
    ).agg(F.avg("value").alias("price"))
    kind = F.col("_kind")
    symbol = F.when(kind == "view", F.lit(PRICE_SYMBOL["view"])).when(kind == "error", F.lit(PRICE_SYMBOL["error"]))
    for name, letter in CONTRACT_LETTER.items():
        if name not in PRICE_SYMBOL:
            symbol = symbol.when(kind == name, F.lit(letter))
    return hourly.select(
        "hour", contract_of(kind).alias("token_address"), symbol.alias("symbol"), "price"
    )


def names_from_customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        wallet_of(F.col("c_custkey")).alias("owner"),
        F.col("c_name").alias("ens_name"),
        F.when(F.col("c_acctbal") > NAME_IN_USE_BALANCE, F.lit("Y")).otherwise(F.lit("N")).alias("ens_set"),
    )


class FixtureTables:
    """The four tables derived from ``{sf_dir}/events.parquet`` and
    ``{sf_dir}/customer.parquet``; each is defined on first use (a logical
    plan only: nothing is read until a query runs)."""

    def __init__(self, spark: SparkSession, sf_dir: str, chunk_events: int = DEFAULT_CHUNK_EVENTS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.chunk_events = chunk_events

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def customer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/customer.parquet")

    @cached_property
    def transfers(self) -> DataFrame:
        return conform(transfers_from_events(self.events, self.chunk_events), "transfers")

    @cached_property
    def sales(self) -> DataFrame:
        return conform(sales_from_events(self.events), "sales")

    @cached_property
    def token_prices(self) -> DataFrame:
        return conform(token_prices_from_events(self.events), "token_prices")

    @cached_property
    def names(self) -> DataFrame:
        return conform(names_from_customers(self.customer), "names")

    def as_tables(self) -> Tables:
        return Tables(self.transfers, self.sales, self.token_prices, self.names)


def fixture_tables(spark: SparkSession, sf_dir: str, chunk_events: int = DEFAULT_CHUNK_EVENTS) -> FixtureTables:
    """The four NFT tables derived from the driver tables in ``sf_dir``."""
    return FixtureTables(spark, sf_dir, chunk_events)
