"""Harrow: Spark DataFrame operators for messy administrative records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
