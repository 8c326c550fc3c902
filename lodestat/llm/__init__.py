"""Preparation of training text: quality, duplicates, leaks, personal data, mixing, scoring."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
