"""Every registered query next to the SQL that checks it."""

from . import registry
from . import scalar, features, scoring, ledgers, matching, graphs, panels, splits, models, ingest, streams  # noqa: F401

queries = registry.queries
oracle_sql = registry.oracle_sql
