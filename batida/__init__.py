"""Time-card extraction and corpus preparation on Spark.

Functions of this package travel to Python workers by value, so executors
need no copy of the repository on their import path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
