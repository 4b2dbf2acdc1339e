"""Contract-address input: the ';'-separated list a user types or picks.

Rule: lower-case the whole text, split on ';', trim spaces from each part,
keep a part only if it is exactly '0x' followed by 40 hex digits, once.
The same rule is given twice: as a plain-Python helper for the parameter
(so the leaderboards can filter with a literal IN list that Parquet pushes
down), and as a Spark expression over a text column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# List separator, address pattern, and the wallets that never
# count as holders (the dead address, the zero address, the one address).
ADDRESS_DELIMITER = ";"
ADDRESS_REGEX = r"\A0x[0-9a-f]{40}\z"
DEAD_ADDRESS = "0x000000000000000000000000000000000000dead"
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
ONE_ADDRESS = "0x0000000000000000000000000000000000000001"
DEFAULT_EXCLUDED_WALLETS = (DEAD_ADDRESS, ZERO_ADDRESS, ONE_ADDRESS)

_PY_ADDRESS = re.compile(r"0x[0-9a-f]{40}")


def _joined(addresses: str | Iterable[str]) -> str:
    if isinstance(addresses, str):
        return addresses
    return ADDRESS_DELIMITER.join(addresses)


def parse_contract_list(addresses: str | Iterable[str]) -> list[str]:
    """Valid, lower-cased, de-duplicated contract addresses in input order."""
    seen: dict[str, None] = {}
    for part in _joined(addresses).lower().split(ADDRESS_DELIMITER):
        part = part.strip(" ")
        if _PY_ADDRESS.fullmatch(part):
            seen.setdefault(part, None)
    return list(seen)


def valid_addresses(text: Column) -> Column:
    """Array of the valid addresses in a ';'-separated text column (same rule)."""
    parts = F.transform(F.split(F.lower(text), ADDRESS_DELIMITER, -1), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(ADDRESS_REGEX)))


def parse_contracts(spark: SparkSession, addresses: str | Iterable[str]) -> DataFrame:
    """One row per valid contract address: DataFrame[nft_contract_address]."""
    one = spark.createDataFrame([(_joined(addresses),)], "input string")
    return one.select(F.explode(valid_addresses(F.col("input"))).alias("nft_contract_address"))
