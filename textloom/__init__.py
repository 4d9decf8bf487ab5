"""textloom: corpus analytics as PySpark DataFrame operators.

Task code is pickled by value, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
