"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors get these functions with their tasks and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
