"""Find, locate and redact sensitive text at scale with Spark."""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel to executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
