"""Display names of wallets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: suffix of a name-service name.
NAME_SUFFIX = ".eth"


def display_name(name: Column, wallet: Column) -> Column:
    """'<name>.eth' when the wallet has a name in use, else the wallet itself."""
    return F.coalesce(F.concat(name, F.lit(NAME_SUFFIX)), wallet)
