"""Transfers stored clustered by token.

A table in buckets by (token, contract), sorted by token and block within them. A
plan that groups or orders transfers by token finds each token's rows in one bucket,
so owners and ranks need no exchange of rows; the contract filter still skips row
groups. Buckets are dealt by both columns, so a large collection spreads over all of
them; a single token is one bucket's, as its rows are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.sources.tables import conform

#: What the table is dealt by, and what it is sorted by within a bucket.
BUCKET_COLUMNS = ("tokenid", "nft_address")
SORT_COLUMNS = ("tokenid", "nft_address", "block_number")


def buckets_for(input_bytes: int, bucket_bytes: int = 256 << 20) -> int:
    """Buckets of about ``bucket_bytes`` each (one task reads one), at least 8."""
    return max(8, -(-input_bytes // bucket_bytes))


def write_clustered(
    transfers: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "errorifexists", fmt: str = "parquet"
) -> None:
    """Store ``transfers`` as table ``name`` in ``buckets`` buckets (at ``path``, or in
    the warehouse). The rows are dealt by the bucket columns first, so that each
    bucket is one sorted file, as a plan without sort or exchange asks for."""
    dealt = conform(transfers, "transfers").repartition(buckets, *BUCKET_COLUMNS)
    writer = dealt.write.format(fmt).mode(mode).bucketBy(buckets, *BUCKET_COLUMNS).sortBy(*SORT_COLUMNS)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_clustered(spark: SparkSession, name: str) -> DataFrame:
    """The table as a ``transfers`` input. The scan keeps its buckets where the plan
    asks for rows by token (``spark.sql.sources.bucketing.enabled``, on by default)."""
    return conform(spark.table(name), "transfers")
