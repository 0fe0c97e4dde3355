"""Network-flow threat analytics on Spark SQL, Spark ML and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
