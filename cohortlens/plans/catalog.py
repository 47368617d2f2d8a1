"""All registered queries: import the query modules so they register."""

from __future__ import annotations

from cohortlens.plans import (q_activity, q_encode, q_eval, q_explain, q_models,  # noqa: F401
                              q_roster, q_vectors)
from cohortlens.plans.registry import ORACLES, QUERIES, ROWS_ONLY

__all__ = ["QUERIES", "ORACLES", "ROWS_ONLY"]
