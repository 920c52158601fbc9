"""Operators that a large training-data pipeline needs.

Nothing outside this subpackage imports it.  Its modules travel to the
executors by value, so that a worker needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
