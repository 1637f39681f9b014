"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Its functions are pickled by value, so executors need only the installed third-party packages.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
