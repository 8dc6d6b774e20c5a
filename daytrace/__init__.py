"""Daily-measurement and activity-record analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

VERSION = "0.1.0"

# The few Python functions that run in tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
