"""Operators for large text corpora: near duplicates, quality, decontamination, tokens, archives, search."""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
