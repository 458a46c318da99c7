"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing else in the library imports this package. Functions that run inside tasks are shipped by value, so executors
need the public libraries only, not a copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
