"""Operators of a training-data pipeline over documents, embeddings and conversations.

Nothing else in the library imports this package.  Each module holds one
operator with its own general interface and the query that applies it to a
whole table; ``registry`` lists the queries.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the plan: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
