"""Keyed, time-bucketed aggregation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
