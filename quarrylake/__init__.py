"""Spark-first toolkit for array-shaped, ragged and hierarchical scientific data.

Functions that run inside Python tasks are shipped by value, so executors need
only the third-party libraries and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
