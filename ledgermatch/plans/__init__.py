"""Plans: join helpers and the composed match (``ledgermatch.plans.pipeline``)."""

from .joins import checked_broadcast, materialize, measure

__all__ = ["checked_broadcast", "materialize", "measure"]
