"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; ``registry`` names its
queries.  Functions that run in Python workers are shipped with the tasks, so
executors need no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
