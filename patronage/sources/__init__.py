"""Input tables: schemas, loading, the static collection catalog and the
mapping that derives the four NFT tables from the driver's test tables."""

from patronage.sources.tables import Tables, conform, load_tables
from patronage.sources.layout import buckets_for, read_clustered, write_clustered
from patronage.sources.catalog import catalog, choose_addresses, manual_collections, select_collections
from patronage.sources.fixture import fixture_tables

__all__ = [
    "Tables",
    "conform",
    "load_tables",
    "catalog",
    "choose_addresses",
    "select_collections",
    "manual_collections",
    "fixture_tables",
    "buckets_for",
    "read_clustered",
    "write_clustered",
]
