"""Spark-native document retrieval, evaluation and training-data analytics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code with them, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
