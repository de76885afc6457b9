"""Tamper-evident ledgers and large-corpus processing as Spark DataFrames.

The package pickles its functions by value, so that executors need no copy of
it: a task carries the code that it runs.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
