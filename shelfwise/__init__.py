"""shelfwise: inventory-policy analytics as Spark DataFrame operators."""

from shelfwise.config import DEFAULT, Thresholds
from shelfwise.pipeline import InventoryPipeline

__all__ = ["DEFAULT", "InventoryPipeline", "Thresholds"]
