"""lexforge: a PySpark-native analytics engine for versioned text corpora.

Functions of this package that run in Python workers are pickled by value, so
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
