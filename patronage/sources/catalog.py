"""The collection catalog the dashboard offers, and the two ways of choosing
contracts from it: by brand/collection name, or by typing addresses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.addresses import ADDRESS_DELIMITER

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("brand", T.StringType(), False),
        T.StructField("collection", T.StringType(), False),
        T.StructField("address", T.StringType(), False),
    ]
)

# The catalog of collections (brand, collection, contract address),
# in the order the selection list shows them.
COLLECTIONS = [
    ("Azuki", "PFP", "0xed5af388653567af2f388e6224dc7c4b3241c544"),
    ("Azuki", "BEANZ", "0x306b1ea3ecdf94ab739f1910bbda052ed4a9f949"),
    ("Doodles LLC", "Doodles", "0x8a90cab2b38dba80c64b7734e58ee1db38b8992e"),
    ("Doodles LLC", "Space Doodles", "0x620b70123fb810f6c653da7644b5dd0b6312e4d8"),
    ("Doodles LLC", "Dooplicators", "0x466cfcd0525189b573e794f554b8a751279213ac"),
    ("Doodles LLC", "Genesis Box", "0xb75f09b4340aeb85cd5f2dd87d31751edc11ed39"),
    ("Memeland", "YOU THE REAL MVP", "0x6efc003d3f3658383f06185503340c2cf27a57b6"),
    ("Memeland", "The Captainz", "0x769272677fab02575e84945f03eca517acc544cc"),
    ("Memeland", "The Potatoz", "0x39ee2c7b3cb80254225884ca001f57118c8f21b6"),
    ("Proof", "Proof Collective", "0x08d7c0242953446436f34b4c78fe9da38c73668d"),
    ("Proof", "Moonbirds", "0x23581767a106ae21c074b2276d25e5c3e136a68b"),
    ("Proof", "Oddities", "0x1792a96e5668ad7c167ab804a100ce42395ce54d"),
    ("RTFKT", "Clone X", "0x49cf6f5d44e70224e2e23fdcdd2c053f30ada28b"),
    ("Yugalabs", "Bored Ape Yacht Club", "0xbc4ca0eda7647a8ab7c2061c2e118a18a936f13d"),
    ("Yugalabs", "Mutant Ape Yacht Club", "0x60e4d786628fea6478f785a6d7e704777c86a7c6"),
    ("Yugalabs", "Bored Ape Kennel Club", "0xba30e5f9bb24caa003e9f2f0497ad287fdf95623"),
    ("Yugalabs", "CryptoPunks", "0xb47e3cd837ddf8e4c57f05d70ab865de6e193bbb"),
    ("Yugalabs", "Meebits", "0x7bd29408f11d2bfc23c34f18275bbf23bb716bc7"),
    ("Yugalabs", "Otherdeed for Otherside", "0x34d85c9cdeb23fa97cb08333b511ac86e1c4e258"),
]

# Fixed value: the brand chosen when nothing else is.
DEFAULT_BRAND = "Memeland"


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a DataFrame (brand, collection, address)."""
    return spark.createDataFrame(COLLECTIONS, CATALOG_SCHEMA)


def select_collections(
    catalog_df: DataFrame,
    brands: Iterable[str] | None = None,
    collections: Iterable[str] | None = None,
) -> DataFrame:
    """Rows of the chosen brands and/or collection names (default: the default brand)."""
    brands = list(brands or [])
    collections = list(collections or [])
    if not brands and not collections:
        brands = [DEFAULT_BRAND]
    cond = F.lit(False)
    if brands:
        cond = cond | F.col("brand").isin(brands)
    if collections:
        cond = cond | F.col("collection").isin(collections)
    return catalog_df.filter(cond)


def choose_addresses(brands: Iterable[str] | None = None, collections: Iterable[str] | None = None) -> list[str]:
    """Addresses of the chosen brands and/or collection names (default: the
    default brand), as a list: the catalog is a constant, so the choice is made
    before any plan and reaches the scans as a literal filter."""
    brands, collections = set(brands or ()), set(collections or ())
    if not brands and not collections:
        brands = {DEFAULT_BRAND}
    return [a for b, c, a in COLLECTIONS if b in brands or c in collections]


def manual_collections(spark: SparkSession, text: str) -> DataFrame:
    """Typed contract list: split on ';', each part used as brand, name and address.

    Parts are kept as typed (validation happens when the leaderboard parses the
    joined list), like the text box of the dashboard.
    """
    one = spark.createDataFrame([(text,)], "text string")
    parts = one.select(F.explode(F.split(F.col("text"), ADDRESS_DELIMITER, -1)).alias("address"))
    return parts.select(
        F.col("address").alias("brand"),
        F.col("address").alias("collection"),
        F.col("address"),
    )


def addresses_of(collections_df: DataFrame) -> DataFrame:
    """The address column of a collection selection."""
    return collections_df.select("address")
