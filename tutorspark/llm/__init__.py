"""Operators for preparing language-model training data; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
