"""Owners, balances and day changes that are kept up day by day.

Each is an aggregate whose partial rows merge: the greatest (block, event, receiver)
of a token, the sum of a wallet's moves of a token, the net change and first receipt
of a wallet's day. A state is a table of such rows; it is built from the transfers
of some days, and the union of states, merged, is the state of all their days. A
later snapshot reads the stored state and the transfers of the new days only:

    state = merge_owners(stored.union(owner_state(new_transfers)))
    owners = owners_of(state)

States of the same days must not be merged twice: balances and changes would count
double. Merging is combined map-side, so a hot token or wallet is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.timefuncs import trunc_ntz
from patronage.operators.ownership import TOKEN_KEYS, TOKEN_SORT_KEYS, signed_moves

# --- owners -----------------------------------------------------------------------


def merge_owners(states: DataFrame) -> DataFrame:
    """(token_id, nft_contract_address, latest): the greatest of each token's rows."""
    return states.groupBy(*TOKEN_SORT_KEYS).agg(F.max("latest").alias("latest"))


def owner_state(ctransfers: DataFrame, kinds_together: bool = False) -> DataFrame:
    """The latest transfer of each token among ``ctransfers``: a struct (block, event,
    receiver, kind). ERC-721 transfers only, or both kinds (see ``current_owner``)."""
    rows = ctransfers if kinds_together else ctransfers.filter(~F.col("is_erc1155"))
    latest = F.struct("block_number", "event_index", "to_address", "is_erc1155").alias("latest")
    return merge_owners(rows.select(*TOKEN_SORT_KEYS, latest))


def owners_of(state: DataFrame) -> DataFrame:
    """``current_owner`` from a state: (wallet, nft_contract_address, token_id, num_held)."""
    return state.filter(~F.col("latest.is_erc1155")).select(
        F.col("latest.to_address").alias("wallet"), *TOKEN_KEYS, F.lit(1).cast("long").alias("num_held")
    )


# --- balances ---------------------------------------------------------------------


def merge_balances(states: DataFrame) -> DataFrame:
    """(wallet, nft_contract_address, token_id, moved): sums, also those of 0 or less,
    which later days can raise again."""
    return states.groupBy("wallet", *TOKEN_KEYS).agg(F.sum("moved").alias("moved"))


def balance_state(ctransfers: DataFrame) -> DataFrame:
    """ERC-1155 tokens received minus sent, per wallet and token."""
    moves = signed_moves(ctransfers.filter(F.col("is_erc1155")), *TOKEN_KEYS)
    return merge_balances(moves.withColumnRenamed("delta", "moved"))


def balances_of(state: DataFrame) -> DataFrame:
    """``token_balances`` from a state: what is above 0."""
    return state.filter(F.col("moved") > 0).withColumnRenamed("moved", "num_held")


# --- day changes ------------------------------------------------------------------


def merge_changes(states: DataFrame) -> DataFrame:
    """(time, wallet, daily_change, first_received) of each day and wallet."""
    return states.groupBy("time", "wallet").agg(
        F.sum("daily_change").alias("daily_change"), F.min("first_received").alias("first_received")
    )


def change_state(ctransfers: DataFrame) -> DataFrame:
    """Net change and first receipt of each wallet on each day of ``ctransfers``."""
    moves = F.explode(
        F.array(
            F.struct(
                F.col("to_address").alias("wallet"),
                F.col("amount").alias("daily_change"),
                F.col("block_time").alias("first_received"),
            ),
            F.struct(
                F.col("from_address").alias("wallet"),
                (-F.col("amount")).alias("daily_change"),
                F.lit(None).cast("timestamp_ntz").alias("first_received"),
            ),
        )
    ).alias("m")
    return merge_changes(ctransfers.select(F.col("day").alias("time"), moves).select("time", "m.*"))


def changes_of(state: DataFrame) -> DataFrame:
    """``daily_change`` from a state."""
    return state.select("time", "wallet", "daily_change")


def days_held_of(state: DataFrame, snapshot: Column) -> DataFrame:
    """``days_held`` from a state, up to the snapshot's day: one window a wallet over
    the days of its changes."""
    after_end = F.date_add(trunc_ntz("day", snapshot).cast("date"), 1)
    per_day = state.filter(F.col("wallet").isNotNull())
    per_wallet = Window.partitionBy("wallet").orderBy("time")
    balance = F.sum("daily_change").over(per_wallet.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    day = F.col("time").cast("date")
    # Days this change stands for: up to the next change, cut after the
    # snapshot's day (least() skips the null lead of a wallet's last change).
    span = F.datediff(F.least(F.lead(day).over(per_wallet), after_end), day)
    counted = F.when(balance > 0, F.greatest(span, F.lit(0))).otherwise(0)
    return (
        per_day.select("wallet", "first_received", counted.alias("_days"))
        .groupBy("wallet")
        .agg(
            F.sum("_days").cast("long").alias("days_held"),
            F.min("first_received").alias("time_first_acquisition"),
        )
        .filter(F.col("time_first_acquisition").isNotNull() & (F.col("days_held") > 0))
    )
