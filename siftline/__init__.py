"""siftline: a PySpark-native engine that ingests, screens, routes and reports on semi-structured postings."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions travel to Python workers with their code, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
