"""Operators for preparing training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value: executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
