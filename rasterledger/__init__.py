"""Evaluation and dataset-governance operators for PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
