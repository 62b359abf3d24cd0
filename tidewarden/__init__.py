"""Event scoring and alerting on PySpark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions by value, so a cluster needs no
# extra --py-files and a driver started from another folder still works.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
