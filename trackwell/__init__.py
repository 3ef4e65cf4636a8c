"""Detection, tracking and text-corpus analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so that executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
