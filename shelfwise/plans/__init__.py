"""Physical-plan helpers: lineage cuts and whole-table ordering."""

from shelfwise.plans.global_order import Key, global_orders, ntile
from shelfwise.plans.materialize import checkpoint_root, materialize

__all__ = ["Key", "checkpoint_root", "global_orders", "materialize", "ntile"]
