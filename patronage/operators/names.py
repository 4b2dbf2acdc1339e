"""Wallet display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.naming import display_name
from patronage.operators.prices import estimated_bytes

#: Names tables of at most this many bytes (Spark's estimate) are broadcast whole.
SMALL_BYTES = 10 << 20


def names_in_use(names: DataFrame, smallest_only: bool = False) -> DataFrame:
    """(owner, ens_name) of names marked in use; with ``smallest_only`` one row
    per owner (its smallest name), combined map-side."""
    in_use = names.filter(F.col("ens_set") == "Y").select("owner", "ens_name")
    if smallest_only:
        in_use = in_use.groupBy("owner").agg(F.min("ens_name").alias("ens_name"))
    return in_use


def with_display_name(
    df: DataFrame, names: DataFrame, wallet_col: str = "wallet", smallest_name: bool = False
) -> DataFrame:
    """Add ``ens_or_wallet`` ('<name>.eth' for a wallet with a name in use, else the wallet).

    A plain left join on the wallet, for tables of any size; a page of a few rows
    goes through ``with_page_names``.
    """
    in_use = names_in_use(names, smallest_only=smallest_name)
    joined = df.join(in_use, df[wallet_col] == in_use["owner"], "left")
    return joined.select(
        *[df[c] for c in df.columns],
        display_name(in_use["ens_name"], df[wallet_col]).alias("ens_or_wallet"),
    )


def with_page_names(
    page: DataFrame,
    names: DataFrame,
    size: int,
    wallet_col: str = "wallet",
    smallest_name: bool = False,
    unique: bool = True,
    small_bytes: int | None = None,
) -> DataFrame:
    """As ``with_display_name`` for a page of at most ``size`` rows, one a wallet: the
    names table is not shuffled.

    A table that Spark estimates at ``small_bytes`` or less (SMALL_BYTES if None) is
    broadcast, read while the page is computed. Any other stays where it is: the
    page is computed once, as the value of a scalar subquery (an array of its
    rows), and unfolded twice: broadcast to the names, so that each task keeps the
    names of the page's wallets only, and as the left side of the join with what was
    found, which is broadcast in turn. Both have a bound that the data cannot exceed:
    ``size`` rows, and a row a wallet (or ``size`` names a wallet, of which no more
    can be on the page, if ``unique`` is false).

    With ``unique`` a wallet with several names in use fails the query, unless
    ``smallest_name`` takes the smallest of them.
    """
    problem = F.raise_error(F.concat(F.lit("names in use: key (owner) is not unique: "), F.col(wallet_col))).cast("string")
    if estimated_bytes(names) <= (SMALL_BYTES if small_bytes is None else small_bytes):
        small = F.broadcast(names_in_use(names, smallest_only=smallest_name))
        named = page.join(small, F.col(wallet_col) == F.col("owner"), "left")
        shown = display_name(F.col("ens_name"), F.col(wallet_col))
        if unique and not smallest_name:  # the page is one partition, so this moves nothing
            shown = F.when(F.count(F.lit(1)).over(Window.partitionBy(wallet_col)) > 1, problem).otherwise(shown)
        return named.select(*page.columns, shown.alias("ens_or_wallet"))
    rows = page.select(F.collect_list(F.struct(*page.columns)).alias("_rows")).scalar()
    # the outer form: Spark infers no filters on the array, each of which would have the
    # subquery optimised once more; an empty page gives a row without a place
    once = page.sparkSession.range(0, 1, 1, 1).select(rows.alias("_rows"))
    again = once.select(F.posexplode_outer("_rows").alias("_place", "_row")).filter("_place IS NOT NULL").select("_row.*")
    wanted = F.broadcast(again.select(F.col(wallet_col).alias("_owner")))
    found = names_in_use(names).join(wanted, F.col("owner") == F.col("_owner")).select("_owner", "ens_name")
    if unique or smallest_name:
        found = found.groupBy("_owner").agg(F.min("ens_name").alias("ens_name"), F.count(F.lit(1)).alias("_n"))
        if not smallest_name:
            found = found.withColumn(wallet_col, F.col("_owner"))
            found = found.select("_owner", F.when(F.col("_n") > 1, problem).otherwise(F.col("ens_name")).alias("ens_name"), "_n")
    else:
        place = F.row_number().over(Window.partitionBy("_owner").orderBy("ens_name"))
        found = found.withColumn("_n", place).filter(F.col("_n") <= size)
    joined = again.join(F.broadcast(found.drop("_n")), F.col(wallet_col) == F.col("_owner"), "left")
    return joined.select(*page.columns, display_name(F.col("ens_name"), F.col(wallet_col)).alias("ens_or_wallet"))
