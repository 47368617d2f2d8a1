"""cohortlens: learner-cohort risk analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus small parameters) and returns a
DataFrame, so the whole flow stays lazy and distributed until an action.
Fitted statistics (medians, quantiles, means, codes) are computed by one
aggregate per fit and carried as small, bounded state objects.
"""

from cohortlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
