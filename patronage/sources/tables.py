"""The four source tables and their Spark schemas.

Types follow use in the leaderboard SQL: addresses and symbols are strings,
money is double, times are TIMESTAMP_NTZ, ``erc1155_value`` is null for
ERC-721 transfers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSFERS_SCHEMA = T.StructType(
    [
        T.StructField("nft_address", T.StringType()),
        T.StructField("tokenid", T.StringType()),
        T.StructField("block_timestamp", T.TimestampNTZType()),
        T.StructField("nft_from_address", T.StringType()),
        T.StructField("nft_to_address", T.StringType()),
        T.StructField("erc1155_value", T.LongType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("event_index", T.IntegerType()),
    ]
)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("seller_address", T.StringType()),
        T.StructField("nft_address", T.StringType()),
        T.StructField("block_timestamp", T.TimestampNTZType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("currency_symbol", T.StringType()),
        T.StructField("currency_address", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("price_usd", T.DoubleType()),
        T.StructField("creator_fee", T.DoubleType()),
        T.StructField("creator_fee_usd", T.DoubleType()),
    ]
)

TOKEN_PRICES_SCHEMA = T.StructType(
    [
        T.StructField("hour", T.TimestampNTZType()),
        T.StructField("token_address", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
    ]
)

NAMES_SCHEMA = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("ens_name", T.StringType()),
        T.StructField("ens_set", T.StringType()),
    ]
)

SCHEMAS = {
    "transfers": TRANSFERS_SCHEMA,
    "sales": SALES_SCHEMA,
    "token_prices": TOKEN_PRICES_SCHEMA,
    "names": NAMES_SCHEMA,
}

# Columns whose type may legitimately differ from the schema above
# (``tx_hash`` is only counted, so a numeric hash is kept as it is).
_FREE_TYPE = {("sales", "tx_hash")}


def conform(df: DataFrame, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the columns of ``table`` by name, cast to the declared types.

    Raises ``ValueError`` naming any missing column. Extra columns are dropped
    here, so Parquet scans read only what the leaderboards use; ``keep`` names
    extra ones to keep (a date partition column, so that folders can be skipped).
    """
    schema = SCHEMAS[table]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {table!r} lacks columns {missing}")
    cols = []
    for field in schema.fields:
        current = df.schema[field.name].dataType
        if (table, field.name) in _FREE_TYPE or current == field.dataType:
            cols.append(F.col(field.name))
        else:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*cols, *[F.col(c) for c in keep if c in df.columns])


@dataclass(frozen=True)
class Tables:
    """The four inputs of both leaderboards."""

    transfers: DataFrame
    sales: DataFrame
    token_prices: DataFrame
    names: DataFrame

    def conformed(self) -> "Tables":
        return Tables(
            conform(self.transfers, "transfers"),
            conform(self.sales, "sales"),
            conform(self.token_prices, "token_prices"),
            conform(self.names, "names"),
        )


def load_tables(
    spark: SparkSession, paths: dict[str, str], fmt: str = "parquet", keep: Sequence[str] = ()
) -> Tables:
    """Read the four tables from storage (``paths`` maps table name to location);
    ``keep`` as in ``conform``."""
    reader = spark.read.format(fmt)
    frames = {name: conform(reader.load(paths[name]), name, keep) for name in SCHEMAS}
    return Tables(**frames)
