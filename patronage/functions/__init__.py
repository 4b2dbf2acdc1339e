"""Column-level building blocks (pure expressions, no joins)."""

from patronage.functions.addresses import (
    ADDRESS_DELIMITER,
    DEFAULT_EXCLUDED_WALLETS,
    parse_contract_list,
    valid_addresses,
    parse_contracts,
)
from patronage.functions.timefuncs import resolve_snapshot, trunc_ntz, as_ntz
from patronage.functions.pricing import eth_value, is_native_eth, div0null
from patronage.functions.naming import display_name

__all__ = [
    "ADDRESS_DELIMITER",
    "DEFAULT_EXCLUDED_WALLETS",
    "parse_contract_list",
    "valid_addresses",
    "parse_contracts",
    "resolve_snapshot",
    "trunc_ntz",
    "as_ntz",
    "eth_value",
    "is_native_eth",
    "div0null",
    "display_name",
]
