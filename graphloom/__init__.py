"""graphloom: code-graph analytics and corpus processing as Spark plans.

Functions that run on executors are pickled by value, so the executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
