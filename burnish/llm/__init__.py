"""Operators for preparing training text, each in a module of its own; nothing else in the library uses them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the job, which need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
