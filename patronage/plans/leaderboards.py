"""The fee leaderboard, the holder leaderboard, and the holding-period
leaderboard the dashboard's title promises.

Shape of every plan: filters on contract and snapshot reach the scans; the big
tables are reduced to one row per wallet by partial + final aggregation;
the first ``page_size`` wallets are taken with a single ordered limit
(TakeOrderedAndProject); only then are those few wallets looked up in the
names table, ranked and cut to the page.
Ties are broken by wallet, then name, so the page is repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.pricing import div0null
from patronage.operators.holding import days_held
from patronage.operators.names import with_page_names
from patronage.operators.ownership import contract_transfers, current_holders, current_owner
from patronage.operators.sales import sales_by_seller
from patronage.plans.params import Params
from patronage.sources.tables import Tables


# The column headers the dashboard shows, kept as column
# metadata ("label") on the leaderboard results. "# of days held" labels the
# holding-period board, which the dashboard only names in its title.
LABELS = {
    "rank": "# RANK",
    "ens_or_wallet": "Wallet",
    "num_held": "# of tokens held",
    "num_collections": "# of collections held",
    "creator_fee_usd": "Creator Fees Paid (USD)",
    "creator_fee_eth": "Creator Fees Paid (ETH)",
    "creator_fee_perc": "Creator Fees Percent",
    "days_held": "# of days held",
}


def ranked_page(
    rows: DataFrame, order: Sequence[Column], tables: Tables, params: Params, columns: Sequence[str]
) -> DataFrame:
    """The page: the first wallets in ``order`` with their names, ranked 1..n.

    The first ``page_size`` wallets are one TakeOrderedAndProject (k rows a task,
    then k). A wallet with several names has several rows, so the rows are
    numbered after the names are known and cut to the page again: every wallet
    gives at least one row, so the page lies within those wallets. The window
    that numbers them is not partitioned; it sees these few rows only. With
    ``params.validate`` a wallet with several names fails the query instead. The
    names table is not shuffled (``with_page_names``).
    """
    top = rows.orderBy(*order).limit(params.page_size)
    named = with_page_names(
        top, tables.names, params.page_size, smallest_name=params.smallest_name, unique=params.validate
    )
    by = Window.orderBy(*order, F.col("ens_or_wallet").asc())
    page = named.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= params.page_size)
    shaped = [F.col(c).alias(c, metadata={"label": LABELS[c]}) for c in ["rank", "ens_or_wallet", *columns]]
    return page.select(*shaped).orderBy("rank")


def fee_leaderboard(tables: Tables, params: Params) -> DataFrame:
    """Who paid the most creator fees on the chosen contracts.

    Columns: rank, ens_or_wallet, creator_fee_usd (null as 0), creator_fee_eth,
    creator_fee_perc (fee / volume in USD, 0 when unknown). Ordered by fee USD.
    """
    snap = params.snapshot()
    sellers = sales_by_seller(
        tables.sales, tables.token_prices, params.addresses, snap, exact_txns=False, unique=params.validate,
        day_column=params.day_column,
    )
    scored = sellers.select(
        "wallet",
        F.coalesce(F.col("creator_fee_usd"), F.lit(0.0)).alias("creator_fee_usd"),
        "creator_fee_eth",
        F.coalesce(div0null(F.col("creator_fee_usd"), F.col("vol_usd")), F.lit(0.0)).alias("creator_fee_perc"),
    )
    order = [F.col("creator_fee_usd").desc(), F.col("wallet").asc()]
    return ranked_page(scored, order, tables, params, ["creator_fee_usd", "creator_fee_eth", "creator_fee_perc"])


def holders_with_fees(tables: Tables, params: Params) -> DataFrame:
    """Current holders (burn addresses out) with their exact-count sales figures."""
    snap = params.snapshot()
    ct = contract_transfers(tables.transfers, params.addresses, snap, day_column=params.day_column)
    holders = current_holders(current_owner(ct), params.excluded_wallets)
    sellers = sales_by_seller(
        tables.sales, tables.token_prices, params.addresses, snap, exact_txns=True, unique=params.validate,
        day_column=params.day_column,
    )
    fees = sellers.select(
        "wallet",
        "creator_fee_usd",
        "creator_fee_eth",
        (F.col("creator_fee_usd") / F.col("vol_usd")).alias("creator_fee_perc"),
    )
    return holders.join(fees, "wallet", "left")


HOLDER_COLUMNS = ["num_held", "num_collections", "creator_fee_usd", "creator_fee_eth", "creator_fee_perc"]


def holder_leaderboard(tables: Tables, params: Params) -> DataFrame:
    """Wallets holding the most tokens of the chosen contracts.

    Columns: rank, ens_or_wallet, num_held, num_collections, creator_fee_usd,
    creator_fee_eth, creator_fee_perc (null for wallets that never sold).
    Ordered by tokens, then collections, then fee USD (no fee first).
    The reference also left-joins days held here without using a column of
    it (one row per wallet, so no effect on the result); it is not computed.
    """
    rows = holders_with_fees(tables, params)
    order = [
        F.col("num_held").desc(),
        F.col("num_collections").desc(),
        F.col("creator_fee_usd").desc_nulls_first(),
        F.col("wallet").asc(),
    ]
    return ranked_page(rows, order, tables, params, HOLDER_COLUMNS)


def holding_period_leaderboard(tables: Tables, params: Params) -> DataFrame:
    """Current holders ranked by days held (the leaderboard's title), then as
    the holder leaderboard. Columns: rank, ens_or_wallet, days_held, then the
    holder columns."""
    snap = params.snapshot()
    ct = contract_transfers(tables.transfers, params.addresses, snap, day_column=params.day_column)
    held = days_held(ct, snap).select("wallet", "days_held")
    rows = holders_with_fees(tables, params).join(held, "wallet", "left")
    order = [
        F.col("days_held").desc_nulls_last(),
        F.col("num_held").desc(),
        F.col("num_collections").desc(),
        F.col("creator_fee_usd").desc_nulls_first(),
        F.col("wallet").asc(),
    ]
    return ranked_page(rows, order, tables, params, ["days_held", *HOLDER_COLUMNS])
