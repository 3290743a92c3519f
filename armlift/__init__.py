"""Controlled-experiment analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions sent to Python workers carry
# their code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
