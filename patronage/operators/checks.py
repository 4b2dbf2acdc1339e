"""Input checks and the snapshot check.

The leaderboards join prices on (hour, token), the WETH price on hour, and
names on owner. Duplicate keys there would multiply sales or holder rows, so
they are checked here and reported loudly rather than silently summed twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.pricing import ETH_REFERENCE_SYMBOL
from patronage.functions.timefuncs import as_ntz


class DuplicateKeyError(ValueError):
    """A key that must be unique occurs more than once."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count (``n``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise DuplicateKeyError with a few examples when ``keys`` is not unique."""
    examples = duplicate_keys(df, keys).take(5)
    if examples:
        shown = ", ".join(str(tuple(r[k] for k in keys)) for r in examples)
        raise DuplicateKeyError(f"{what}: key {tuple(keys)} is not unique, e.g. {shown}")


def check_inputs(tables) -> None:
    """Check the join keys the leaderboards rely on (three aggregate jobs)."""
    prices = tables.token_prices
    assert_unique(prices, ["hour", "token_address"], "hourly token prices")
    assert_unique(prices.filter(F.col("symbol") == ETH_REFERENCE_SYMBOL), ["hour"], "WETH prices")
    assert_unique(tables.names.filter(F.col("ens_set") == "Y"), ["owner"], "names in use")


def check_snapshot(transfers: DataFrame, snapshot: Column, now=None, day_column: str | None = None) -> DataFrame:
    """(actual_snapshot_time): the snapshot, or one day earlier when the newest
    transfer of the last 24 hours is older than the snapshot (the day is not
    complete yet). No transfer in the last 24 hours keeps the snapshot.

    Reads the transfers of every contract; ``day_column`` names a date partition
    column, so that only the folders of the last two days are read.
    """
    current = as_ntz(now)
    since = current - F.expr("INTERVAL 24 HOURS")
    recent = transfers.filter(F.col("block_timestamp") > since)
    if day_column:
        recent = recent.filter(F.col(day_column).cast("date") >= since.cast("date"))
    newest = recent.agg(F.max("block_timestamp").alias("block_time"))
    actual = F.when(F.col("block_time") < snapshot, snapshot - F.expr("INTERVAL 1 DAY")).otherwise(snapshot)
    return newest.select(actual.alias("actual_snapshot_time"))
