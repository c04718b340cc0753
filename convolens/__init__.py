"""Spark-native analytics for customer-service conversations."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with the job, so executors need not have
# this package installed.
register_pickle_by_value(sys.modules[__name__])
