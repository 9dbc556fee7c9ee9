"""Operators for preparing large text collections: one module per operator, queries in ``queries``.

Nothing else in the library imports this package.  Functions that run in Python workers are sent by
value, so that executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
