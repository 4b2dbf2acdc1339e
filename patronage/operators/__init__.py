"""DataFrame -> DataFrame steps of the two leaderboards."""

from patronage.operators.ordered import previous_in_group, position_in_group, positions_in_group
from patronage.operators.prices import count_cells, hourly_rates, rate_vectors, vectors_for_join
from patronage.operators.sales import (
    sales_in_scope,
    sale_eth_values,
    sales_by_seller,
    seller_days,
    merge_seller_days,
    unpriced_sales,
)
from patronage.operators.contracts import in_contracts, maybe_in
from patronage.operators.ownership import (
    contract_transfers,
    current_owner,
    token_balances,
    all_holdings,
    current_holders,
)
from patronage.operators.holding import (
    first_acquisition,
    calendar,
    daily_change,
    days_held,
)
from patronage.operators.kept import (
    balance_state,
    balances_of,
    change_state,
    changes_of,
    days_held_of,
    merge_balances,
    merge_changes,
    merge_owners,
    owner_state,
    owners_of,
)
from patronage.operators.names import with_display_name, with_page_names
from patronage.operators.checks import (
    DuplicateKeyError,
    assert_unique,
    check_inputs,
    check_snapshot,
)

__all__ = [
    "previous_in_group",
    "position_in_group",
    "positions_in_group",
    "sales_in_scope",
    "hourly_rates",
    "rate_vectors",
    "vectors_for_join",
    "count_cells",
    "sale_eth_values",
    "sales_by_seller",
    "seller_days",
    "merge_seller_days",
    "unpriced_sales",
    "in_contracts",
    "maybe_in",
    "contract_transfers",
    "current_owner",
    "token_balances",
    "all_holdings",
    "current_holders",
    "first_acquisition",
    "calendar",
    "daily_change",
    "days_held",
    "balance_state",
    "balances_of",
    "change_state",
    "changes_of",
    "days_held_of",
    "merge_balances",
    "merge_changes",
    "merge_owners",
    "owner_state",
    "owners_of",
    "with_display_name",
    "with_page_names",
    "DuplicateKeyError",
    "assert_unique",
    "check_inputs",
    "check_snapshot",
]
