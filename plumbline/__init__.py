"""Corpus invariants on Spark: operators, sources, functions and rules over DataFrames.

Functions of this package are pickled by value, so executors need only the installed third-party packages.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
