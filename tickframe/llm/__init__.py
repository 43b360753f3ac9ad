"""Operators for preparing text corpora. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the task: executors need not have the library on their path.
register_pickle_by_value(sys.modules[__name__])
