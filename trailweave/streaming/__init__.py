"""Streams of accesses, and what is known of them between batches."""

import sys

from pyspark import cloudpickle

# What keeps state travels to the executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
