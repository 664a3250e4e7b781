"""Operators for preparing training text, and their registered queries.

The functions that run inside Python workers are pickled by value, so the
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
