"""All registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from . import history, mining, passes, reports, review, selection, whole

QUERIES = history.QUERIES | review.QUERIES | selection.QUERIES | mining.QUERIES | reports.QUERIES | passes.QUERIES | whole.QUERIES
SQL = history.SQL | review.SQL | selection.SQL | mining.SQL | reports.SQL | passes.SQL
