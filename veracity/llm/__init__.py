"""Operators of a training-data pipeline over a ``documents`` table.

Each module holds one operator with its own general interface; ``queries``
registers one production query per operator.  Nothing outside this package
imports it.
"""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that these need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
