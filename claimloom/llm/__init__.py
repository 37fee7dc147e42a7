"""Operators for preparing training text at scale; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# what the operators send to the executors goes by value, so the executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
