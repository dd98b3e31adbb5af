"""The queries over clips, runs or drafts again, with one clip for each document instead of one for each of its utterances.

SQL has no distance between long lists (the codes of the edit distance end at 94 words), so these have none.  Tests compare
first_wins_text, dedupe_by_trust, dup_suffix and leaderboard with brute force; the others are the same jobs over longer rows.
"""

from __future__ import annotations

from ..sources import views
from . import history, mining, review, selection

OVER_TEXTS = (
    "leaderboard category_backend_summary bucket_rollup_with_all paired_delta_ci quality_gate worst_k_per_bucket dedupe_by_trust dup_suffix first_wins_text stable_prefix "
    "draft_gold crosscheck term_coverage ordered_checks quota_sample "
    "update_reasons text_quality degenerate_runs first_usable app_scores tool_summary field_scorecard prefix_quality best_or_unclear ranked_by_keywords continue_drafts"
).split()


def _whole(query):
    def run(spark, sf_dir):
        with views.whole():
            return query(spark, sf_dir)

    return run


_ALL = history.QUERIES | review.QUERIES | selection.QUERIES | mining.QUERIES
QUERIES = {f"{name}_whole": _whole(query) for name, query in _ALL.items() if name in OVER_TEXTS or name.startswith("two_phase")}
