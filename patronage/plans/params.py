"""Leaderboard parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from patronage.functions.addresses import DEFAULT_EXCLUDED_WALLETS
from patronage.functions.timefuncs import TimeLike, resolve_snapshot

# Default snapshot (far future, so "start of today"), page size,
# and the creator-fee share the dashboard passes but never uses.
DEFAULT_SNAPSHOT = "2032-01-01 12:00"
DEFAULT_PAGE_SIZE = 10
DEFAULT_CREATOR_FEE_PERC = 0.03


@dataclass(frozen=True)
class Params:
    """What a leaderboard is asked for.

    ``addresses``: ';'-separated text, a list of addresses, or a DataFrame whose
    first column holds addresses (e.g. a catalog selection).
    ``now``: fixed "current time" (default: the session's local time), so that
    results can be repeated.
    ``validate`` (default): the query fails, while it runs, when it meets a price
    key or a wallet of the page that is not unique; without it duplicate prices
    multiply sales and a wallet with two names has two rows, as plain joins do.
    ``day_column``: name of a date partition column of the stored tables (kept by
    ``load_tables(keep=[...])``): folders of days after the snapshot are not read, in
    each of transfers, sales and prices that has the column.
    ``smallest_name``: if a wallet has several names in use, show the smallest
    instead.
    """

    addresses: str | Iterable[str] | DataFrame
    snapshot_time: TimeLike = DEFAULT_SNAPSHOT
    now: TimeLike = None
    page_size: int = DEFAULT_PAGE_SIZE
    excluded_wallets: tuple[str, ...] = field(default=DEFAULT_EXCLUDED_WALLETS)
    creator_fee_perc: float = DEFAULT_CREATOR_FEE_PERC
    validate: bool = True
    smallest_name: bool = False
    day_column: str | None = None

    def __post_init__(self) -> None:
        if self.page_size < 1:
            raise ValueError(f"page_size must be at least 1, not {self.page_size}")
        if not isinstance(self.addresses, (str, DataFrame)):
            object.__setattr__(self, "addresses", tuple(self.addresses))  # an iterator is read once only

    def snapshot(self) -> Column:
        return resolve_snapshot(self.snapshot_time, self.now)
