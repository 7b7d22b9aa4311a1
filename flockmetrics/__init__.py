"""Social-graph analytics on Spark: users, channels, posts, reactions and follows."""

from flockmetrics.clock import Clock
from flockmetrics.settings import Settings
from flockmetrics.sources.tables import SocialTables

__all__ = ["Clock", "Settings", "SocialTables"]
