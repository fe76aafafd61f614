"""flowdrift: network-flow features, conformal drift detection and retraining on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel inside the jobs that use them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
