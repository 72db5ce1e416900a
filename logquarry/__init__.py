"""Log analytics on Spark DataFrames: numbered lines, rule findings, a findings store and documentation retrieval."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
