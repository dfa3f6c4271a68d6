"""Monthly activity rollups, rankings and many-series forecasts on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so the package need not be
# installed or on the path of the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
