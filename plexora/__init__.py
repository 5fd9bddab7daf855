"""Spark-native analytics for wide measurement tables and the networks made of them."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors need not have the package installed: its functions travel by value
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
