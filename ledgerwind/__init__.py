"""Spark-native revenue and collections analytics."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the task, so
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
