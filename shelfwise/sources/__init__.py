from shelfwise.sources.inventory import (
    RAW_COLUMNS,
    RAW_SCHEMA,
    conform,
    inventory_from_tpch,
    quarantine,
    read_inventory,
)
from shelfwise.sources.sinks import manifest, publish_marts, read_mart, write_mart

__all__ = [
    "RAW_COLUMNS",
    "RAW_SCHEMA",
    "conform",
    "inventory_from_tpch",
    "manifest",
    "publish_marts",
    "quarantine",
    "read_inventory",
    "read_mart",
    "write_mart",
]
