"""Spark-first analytics over byte payloads: damage, recovery, inspection and recipes."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so that no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
