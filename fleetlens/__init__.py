"""Inference-fleet analytics on Spark: SLOs, fleet state, incidents and batch jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the job, so only the
# driver needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
