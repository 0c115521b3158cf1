"""Operators for training-data pipelines; nothing else in the library imports this package.

The package is pickled by value, so executors need no copy of it on their
Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
