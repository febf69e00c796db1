"""Operators for preparing training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

#: Executors get the functions by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["sieveline"])
