"""Operators for preparing training text; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors by value: workers need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
