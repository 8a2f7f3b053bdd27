"""Event-stream analytics on Spark: plain functions from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions and processors handed to Spark travel by value, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
