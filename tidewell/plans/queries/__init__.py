from tidewell.plans.queries import (  # noqa: F401
    alerting,
    changes,
    contracts,
    loading,
    quality,
    shaping,
    text,
)
from tidewell.plans.queries.book import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
