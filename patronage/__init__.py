"""patronage: wallet leaderboards for chosen NFT collections, as Spark DataFrame jobs.

Four input tables (transfers, sales, hourly token prices, wallet names) go in as
DataFrames; every step (address parsing, snapshot time, sales per seller, current
owner, balances, daily change, days held, leaderboards) is a function from
DataFrames to a DataFrame built on Spark's own joins, windows and aggregates.
"""

from patronage.sources.tables import Tables, load_tables
from patronage.plans.params import Params
from patronage.plans.leaderboards import (
    fee_leaderboard,
    holder_leaderboard,
    holding_period_leaderboard,
)

__all__ = [
    "Tables",
    "load_tables",
    "Params",
    "fee_leaderboard",
    "holder_leaderboard",
    "holding_period_leaderboard",
]
