"""Operators for preparing text corpora.

Functions that run in Python tasks are shipped with the tasks, so executors need the
third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
