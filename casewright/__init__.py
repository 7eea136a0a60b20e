"""casewright: link analysis and evidence analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
