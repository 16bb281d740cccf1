"""Spark functions for administrative reports and for searching document collections."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
