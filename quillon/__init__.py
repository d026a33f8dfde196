"""quillon: document analytics on Spark DataFrames.

Functions that run inside Python workers are pickled by value, so executors need
only PySpark and the numeric libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
