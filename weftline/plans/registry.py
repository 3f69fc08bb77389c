"""All queries over the library's operators by name, and the SQL that states the same result."""

from __future__ import annotations

from weftline.plans import answers, builders, corpus, dialects, extras, features, feeds, loops, measures, preparation, prepared, rollouts  # noqa: F401  they register their queries
from weftline.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
