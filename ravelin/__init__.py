"""Spark-native analytics over revision-versioned evidence graphs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code: no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
