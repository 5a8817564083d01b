"""Thema: additively regularized topic modelling and corpus processing on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The package's functions travel to the workers by value, so that executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
