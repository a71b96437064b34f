"""Training-data operators. Nothing else in the package imports this subpackage.

Functions that run on executors are pickled by value, so the executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
