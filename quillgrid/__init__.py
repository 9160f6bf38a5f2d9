"""Quillgrid: messy tables to typed tables, profiles and reports, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python task functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
