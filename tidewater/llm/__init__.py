"""Operators for large-scale training-data pipelines. Nothing else in the library imports this package.

Functions that run on executors travel by value, so executors need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
