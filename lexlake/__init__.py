"""Regulatory-document analytics on Spark: Bronze -> Silver -> Gold -> compliance."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so that workers
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
