"""Segmentation analytics for mixed-type tables, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship task functions by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
