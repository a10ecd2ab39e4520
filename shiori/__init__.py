"""Batch hybrid search over text catalogues, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
