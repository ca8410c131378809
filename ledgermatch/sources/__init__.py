from .fixtures import derive_sources, fixture_config
from .tables import SCHEMAS, DatePartition, Sources, conform, read_sources

__all__ = ["SCHEMAS", "DatePartition", "Sources", "conform", "derive_sources", "fixture_config", "read_sources"]
