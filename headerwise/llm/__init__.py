"""Operators for preparing training data. Nothing else in the library imports this.

The functions that run in Python workers are shipped with each job, so executors
need the third-party packages only, not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
