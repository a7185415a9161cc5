"""Spark-native analytics over ordered event sequences.

Modules are pickled by value, so that Python workers need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
