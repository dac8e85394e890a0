"""Operators for cleaning and encoding training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the jobs that use them; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
