"""auditspark: deterministic audit analytics and corpus preparation on Spark DataFrames.

Functions that run in Python workers are sent by value, so executors need no copy of the package."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
