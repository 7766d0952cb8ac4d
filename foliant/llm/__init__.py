"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions that run inside tasks are sent along by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
