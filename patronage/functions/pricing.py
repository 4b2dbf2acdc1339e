"""Converting sale amounts to ETH."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies whose amounts are already in ETH, and the symbol
# whose hourly price is the ETH reference price.
NATIVE_SYMBOLS = ("ETH", "WETH")
ETH_REFERENCE_SYMBOL = "WETH"


def is_native_eth(symbol: Column) -> Column:
    """True when the amount is already ETH; a null symbol is not."""
    return F.coalesce(symbol.isin(*NATIVE_SYMBOLS), F.lit(False))


def eth_value(amount: Column, symbol: Column, rate: Column) -> Column:
    """Amount in ETH: kept for ETH/WETH, else the amount at that hour's rate (token
    price / WETH price). Without a rate it is null (left out of sums)."""
    return F.when(is_native_eth(symbol), amount).otherwise(amount * rate)


def div0null(num: Column, den: Column) -> Column:
    """num / den, or 0 when den is 0 or null."""
    return F.when(den.isNull() | (den == 0), F.lit(0.0)).otherwise(num / den)
