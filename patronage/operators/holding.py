"""Holding history: first acquisition, calendar, daily change, days held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.timefuncs import trunc_ntz
from patronage.operators.kept import change_state, days_held_of
from patronage.operators.ownership import signed_moves


def first_acquisition(ctransfers: DataFrame) -> DataFrame:
    """(wallet, time_first_acquisition): earliest receipt of each receiver."""
    return ctransfers.groupBy(F.col("to_address").alias("wallet")).agg(
        F.min("block_time").alias("time_first_acquisition")
    )


def calendar(ctransfers: DataFrame, snapshot: Column) -> DataFrame:
    """One row per day (``time``) from the first transfer's day to the snapshot's day."""
    first = ctransfers.agg(F.min("day").cast("date").alias("start"))
    end = trunc_ntz("day", snapshot).cast("date")
    days = F.when(F.col("start") <= end, F.sequence(F.col("start"), end)).otherwise(
        F.array().cast("array<date>")
    )
    return first.select(F.explode(days).alias("day")).select(F.col("day").cast("timestamp_ntz").alias("time"))


def daily_change(ctransfers: DataFrame) -> DataFrame:
    """(time, wallet, daily_change): tokens received minus tokens sent per wallet and day.

    One pass: each transfer becomes a +amount row for the receiver and a
    -amount row for the sender, summed per (day, wallet) with a map-side
    partial aggregate (so the zero address that sends every mint is combined
    before the shuffle).
    """
    moves = signed_moves(ctransfers, "day")
    return moves.groupBy(F.col("day").alias("time"), "wallet").agg(
        F.sum("delta").alias("daily_change")
    )


def days_held(ctransfers: DataFrame, snapshot: Column) -> DataFrame:
    """(wallet, days_held, time_first_acquisition) for receivers that held for at least one day.

    ``days_held`` counts calendar days whose end-of-day running balance is
    above 0. Computed sparsely: only the days a wallet's balance changes are
    materialised; each change day stands for the days up to the next change
    (or to the snapshot's day). Equal to a calendar-times-wallets form, without
    its days x wallets rows.

    One aggregate per (day, wallet) carries both the net change and the
    earliest receipt of that day; one window per wallet (bounded by the
    number of calendar days, not by the data) gives the running balance and
    the next change day; the per-wallet total then also takes the first
    receipt, so no second aggregate and no join are needed. Wallets that
    never received are left out.
    """
    return days_held_of(change_state(ctransfers), snapshot)
