"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel with their tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
