"""maskloom: a Spark-native engine that masks sensitive spans in documents and restores them later.

Functions that run on executors are pickled by value, so workers need no copy of this package on
their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
