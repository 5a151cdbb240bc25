"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# tasks get the functions of this folder with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
