"""Ordered operations inside groups that may be very large.

A window ``PARTITION BY token ORDER BY block`` sends a whole group to one
task. One token (or one wallet) can hold a large share of all transfers, so
these helpers never do that. Each group is cut into chunks by a column that
never decreases along the order (for example ``block_number div N``): the row
window runs per (group, chunk), which bounds the rows one task sorts, and what
a chunk needs from the chunks before it (the last value, or the number of
earlier rows) comes from a per-chunk aggregate (one row per group and chunk,
partially aggregated before its shuffle). That carry enters each chunk as one
extra "carry" row sorted in front, so no join with the big side is needed:
one shuffle of the rows, plus a small shuffle of the chunk table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CARRY_FLAG = "_carry_row"
_CARRY = "_carry"


def _with_carry_rows(df: DataFrame, carry: DataFrame) -> DataFrame:
    rows = df.withColumn(_CARRY_FLAG, F.lit(False))
    return rows.unionByName(carry.withColumn(_CARRY_FLAG, F.lit(True)), allowMissingColumns=True)


def previous_in_group(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same ``keys`` group,
    ordered ascending by ``order`` (null for the first row of a group).

    ``chunk`` must be a column of ``df`` that never decreases along ``order``
    inside a group. The order should be total inside a group.
    """
    keys = list(keys)
    # the greatest (order..., value) of each chunk; with a total order this is
    # the chunk's last row
    last = F.max(F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))).alias("_last")
    last_of_chunk = df.groupBy(*keys, chunk).agg(last).select(*keys, chunk, F.col("_last._v").alias(_CARRY))
    before = Window.partitionBy(*keys).orderBy(chunk)
    carry = last_of_chunk.select(*keys, chunk, F.lag(_CARRY).over(before).alias(_CARRY))

    both = _with_carry_rows(df.withColumn(_CARRY, F.lit(None).cast(df.schema[value].dataType)), carry)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(F.col(_CARRY_FLAG).desc(), *[F.col(c).asc() for c in order])
    step_value = F.when(F.col(_CARRY_FLAG), F.col(_CARRY)).otherwise(F.col(value))
    return (
        both.withColumn(out, F.lag(step_value).over(in_chunk))
        .filter(~F.col(_CARRY_FLAG))
        .drop(_CARRY_FLAG, _CARRY)
    )


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Add ``out`` = 1-based ROW_NUMBER of each row in its ``keys`` group.

    ``order`` holds sort expressions (``F.col(c).desc()`` ...); ``descending``
    says whether they run against ``chunk`` (so chunks are visited last-first).
    """
    keys = list(keys)
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    chunk_order = F.col(chunk).desc() if descending else F.col(chunk).asc()
    earlier = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(_CARRY))

    both = _with_carry_rows(df.withColumn(_CARRY, F.lit(None).cast("long")), carry)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(F.col(_CARRY_FLAG).desc(), *order)
    offset = F.first(F.col(_CARRY), ignorenulls=True).over(in_chunk)
    return (
        both.withColumn(out, (F.row_number().over(in_chunk) - 1 + offset).cast("long"))
        .filter(~F.col(_CARRY_FLAG))
        .drop(_CARRY_FLAG, _CARRY)
    )


def positions_in_group(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    forward: str,
    backward: str,
) -> DataFrame:
    """Add both 1-based positions of each row in its ``keys`` group: ``forward`` in
    ascending ``order``, ``backward`` in descending order.

    One shuffle of the rows: the carry row of a chunk brings the rows before it and
    the rows of the whole group, and the backward position follows from the forward
    one.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys).orderBy(chunk)
    earlier = F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carry = counts.select(*keys, chunk, F.struct(earlier.alias("earlier"), total.alias("total")).alias(_CARRY))

    both = _with_carry_rows(df.withColumn(_CARRY, F.lit(None).cast(carry.schema[_CARRY].dataType)), carry)
    in_chunk = Window.partitionBy(*keys, chunk).orderBy(F.col(_CARRY_FLAG).desc(), *[F.col(c).asc() for c in order])
    brought = F.first(F.col(_CARRY), ignorenulls=True).over(in_chunk)
    return (
        both.withColumns({_CARRY: brought, forward: F.row_number().over(in_chunk)})
        .filter(~F.col(_CARRY_FLAG))
        .withColumn(forward, (F.col(forward) - 1 + F.col(_CARRY)["earlier"]).cast("long"))
        .withColumn(backward, (F.col(_CARRY)["total"] + 1 - F.col(forward)).cast("long"))
        .drop(_CARRY_FLAG, _CARRY)
    )
