"""Search over study documents and matching of people to studies, on Spark."""

from matchloom.plans.analysis import Analysis, analyze_and_match
from matchloom.plans.cohort import Cohorts, find_eligible_patients, match_cohorts
from matchloom.plans.search import (
    SearchIndex,
    read_search_index,
    search_summary,
    search_trials,
    write_search_index,
)

__all__ = [
    "Analysis",
    "Cohorts",
    "SearchIndex",
    "analyze_and_match",
    "find_eligible_patients",
    "match_cohorts",
    "read_search_index",
    "search_summary",
    "search_trials",
    "write_search_index",
]
