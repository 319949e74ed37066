"""flowscope: analytics over labelled network-flow tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to Spark tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
