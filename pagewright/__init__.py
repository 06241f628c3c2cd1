"""Website intelligence and corpus preparation as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
