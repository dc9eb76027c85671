"""Spark jobs for timetable and pursuit analytics, and for preparing training data."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
