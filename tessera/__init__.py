"""Column-parameterised DataFrame operators for ordered series, scattered points and trial tables."""

import sys

from pyspark import cloudpickle

# the helpers that run in Python workers travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
