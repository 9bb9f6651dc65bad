"""Spark-native analytics for review-fraud detection on reviewer-product graphs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to Python workers whole, so that executors need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
