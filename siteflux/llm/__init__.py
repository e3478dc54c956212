"""Operators that turn a corpus of documents into training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions for tasks travel by value: workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
