"""Operators for preparing text as training data. Nothing outside imports this package.

Functions that run in tasks travel with the task, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
