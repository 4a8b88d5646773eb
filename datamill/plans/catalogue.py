"""All queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

from datamill.plans import contexts, core, evaluating, folders, running, texts
from datamill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contexts", "core", "evaluating", "folders", "running", "texts"]
