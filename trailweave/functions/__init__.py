"""Column functions."""

import sys

from pyspark import cloudpickle

# Functions that tasks call travel to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
