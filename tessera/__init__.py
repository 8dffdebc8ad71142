"""Explanation-guided tabular classification as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
