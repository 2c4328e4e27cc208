"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules["tileloom"])
