"""Spark-native analytics for object-level survey tables and large text corpora."""

import sys

from pyspark import cloudpickle

# Executors get the code with each task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
