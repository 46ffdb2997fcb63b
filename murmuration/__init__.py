"""Account-coordination signals on Spark: features, edges, text similarity, clusters.

Every function takes and returns lazy DataFrames. Scores are observable signals for
people to review; nothing here decides that an account is automated.
"""

import sys

from pyspark import cloudpickle

from murmuration.config import DELETED, Settings
from murmuration.session import build_session, prepare

__all__ = ["DELETED", "Settings", "build_session", "prepare"]

# Functions that run inside tasks travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
