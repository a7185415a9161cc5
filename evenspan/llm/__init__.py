"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Modules are pickled by value, so that
workers need the third-party libraries only and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
