"""Whole leaderboards composed from the operators."""

from patronage.plans.params import Params
from patronage.plans.leaderboards import (
    fee_leaderboard,
    holder_leaderboard,
    holding_period_leaderboard,
    ranked_page,
)

__all__ = ["Params", "fee_leaderboard", "holder_leaderboard", "holding_period_leaderboard", "ranked_page"]
