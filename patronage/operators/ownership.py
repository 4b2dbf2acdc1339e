"""Transfers of the chosen contracts, current owners, balances and holders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.addresses import DEFAULT_EXCLUDED_WALLETS
from patronage.functions.timefuncs import trunc_ntz
from patronage.operators.contracts import Contracts, in_contracts
from patronage.operators.ordered import position_in_group, positions_in_group

# Blocks per chunk of the per-token rank window: one task sorts at most the
# transfers of one token within this many blocks.
DEFAULT_CHUNK_BLOCKS = 100_000

TOKEN_KEYS = ["nft_contract_address", "token_id"]
# The same keys in the order used to group and partition: token first. After
# the contract filter only a few contracts remain, and a sort whose leading
# key barely varies falls back to comparing whole strings (about 10% of the
# per-token window's time at 1.6M events).
TOKEN_SORT_KEYS = ["token_id", "nft_contract_address"]


def contract_transfers(
    transfers: DataFrame,
    contracts: Contracts,
    snapshot: Column,
    include_erc1155: bool = False,
    with_rank: bool = False,
    with_rank_asc: bool = False,
    chunk_blocks: int = DEFAULT_CHUNK_BLOCKS,
    day_column: str | None = None,
) -> DataFrame:
    """Transfers of the chosen contracts up to and including the snapshot.

    ``day_column`` names a date partition column of ``transfers`` (see
    ``conform``), so that day folders after the snapshot are not listed.

    Columns: nft_contract_address, token_id, block_time, day, from_address,
    to_address, amount (ERC-1155 value, else 1), is_erc1155, block_number,
    event_index; with ``with_rank`` also ``rank_desc`` (1 = latest transfer of
    the token), with ``with_rank_asc`` also ``rank_asc`` (1 = mint); both together
    come from one shuffle of the rows.
    ERC-1155 transfers are left out unless ``include_erc1155``.
    """
    cond = F.col("block_timestamp") <= snapshot
    if day_column and day_column in transfers.columns:
        cond = cond & (F.col(day_column).cast("date") <= snapshot.cast("date"))
    if not include_erc1155:
        cond = cond & F.col("erc1155_value").isNull()
    t = in_contracts(transfers, "nft_address", contracts, also=cond)
    out = t.select(
        F.col("nft_address").alias("nft_contract_address"),
        F.col("tokenid").alias("token_id"),
        F.col("block_timestamp").alias("block_time"),
        trunc_ntz("day", F.col("block_timestamp")).alias("day"),
        F.col("nft_from_address").alias("from_address"),
        F.col("nft_to_address").alias("to_address"),
        F.coalesce(F.col("erc1155_value"), F.lit(1)).cast("long").alias("amount"),
        F.col("erc1155_value").isNotNull().alias("is_erc1155"),
        F.col("block_number"),
        F.col("event_index"),
    )
    if not (with_rank or with_rank_asc):
        return out
    out = out.withColumn("_chunk", F.expr(f"block_number div {int(chunk_blocks)}"))
    keys = ("block_number", "event_index", "to_address", "from_address")
    if with_rank and with_rank_asc:
        out = positions_in_group(out, TOKEN_SORT_KEYS, "_chunk", keys, "rank_asc", "rank_desc")
        return out.select(*[c for c in out.columns if c not in ("_chunk", "rank_asc", "rank_desc")], "rank_desc", "rank_asc")
    if with_rank:
        out = position_in_group(
            out, TOKEN_SORT_KEYS, "_chunk", [F.col(c).desc() for c in keys], "rank_desc", descending=True
        )
    if with_rank_asc:
        out = position_in_group(out, TOKEN_SORT_KEYS, "_chunk", [F.col(c).asc() for c in keys], "rank_asc")
    return out.drop("_chunk")


def current_owner(ctransfers: DataFrame, kinds_together: bool = False) -> DataFrame:
    """ERC-721 holdings: the receiver of each token's latest transfer.

    (wallet, nft_contract_address, token_id, num_held=1). An aggregate, the
    greatest (block, event, receiver) per token, rather than a rank window: it
    is combined map-side, so a token with a huge history costs one partial row
    per task, not one task. (block, event) identifies an ERC-721 transfer;
    should it ever repeat, the greater receiver wins, as in ``rank_desc``
    (block, event, receiver, sender), so the result is still repeatable.

    By default only ERC-721 transfers are looked at; with ``kinds_together`` a
    token whose latest transfer of either kind is ERC-1155 has no owner.
    """
    rows = ctransfers if kinds_together else ctransfers.filter(~F.col("is_erc1155"))
    latest = F.max(F.struct("block_number", "event_index", "to_address", "is_erc1155")).alias("latest")
    return (
        rows.groupBy(*TOKEN_SORT_KEYS)
        .agg(latest)
        .filter(~F.col("latest.is_erc1155"))
        .select(F.col("latest.to_address").alias("wallet"), *TOKEN_KEYS, F.lit(1).cast("long").alias("num_held"))
    )


def signed_moves(ctransfers: DataFrame, *carry: str) -> DataFrame:
    """Two rows per transfer: the receiver gains ``amount``, the sender loses it."""
    moves = F.explode(
        F.array(
            F.struct(F.col("to_address").alias("wallet"), F.col("amount").alias("delta")),
            F.struct(F.col("from_address").alias("wallet"), (-F.col("amount")).alias("delta")),
        )
    ).alias("m")
    return ctransfers.select(*carry, moves).select(*carry, "m.wallet", "m.delta")


def token_balances(ctransfers: DataFrame) -> DataFrame:
    """ERC-1155 holdings: per wallet and token, received minus sent, kept when > 0.

    ``ctransfers`` must come from ``contract_transfers(..., include_erc1155=True)``.
    """
    moves = signed_moves(ctransfers.filter(F.col("is_erc1155")), *TOKEN_KEYS)
    return (
        moves.groupBy("wallet", *TOKEN_KEYS)
        .agg(F.sum("delta").alias("num_held"))
        .filter(F.col("num_held") > 0)
    )


def all_holdings(
    ctransfers: DataFrame, include_erc1155: bool = True, kinds_together: bool = False
) -> DataFrame:
    """ERC-721 owners, plus ERC-1155 balances when asked (num_held as bigint).
    ``kinds_together``: owners by the rank over both kinds, see current_owner."""
    held = current_owner(ctransfers, kinds_together)
    if include_erc1155:
        held = held.unionByName(token_balances(ctransfers))
    return held


def current_holders(
    holdings: DataFrame, excluded_wallets: Iterable[str] = DEFAULT_EXCLUDED_WALLETS
) -> DataFrame:
    """Per wallet: num_collections (distinct contracts) and num_held (tokens).

    Burn and zero addresses are left out; a null wallet never counts.
    Two plain sums, by wallet and contract and then by wallet, both combined
    map-side; no set of contracts is held in memory.
    """
    excluded = [w.lower() for w in excluded_wallets]
    kept = holdings.filter(~F.col("wallet").isin(excluded)) if excluded else holdings.filter(
        F.col("wallet").isNotNull()
    )
    per_contract = kept.groupBy("wallet", "nft_contract_address").agg(F.sum("num_held").alias("num_held"))
    return per_contract.groupBy("wallet").agg(
        F.count("nft_contract_address").alias("num_collections"),
        F.sum("num_held").cast("long").alias("num_held"),
    )
