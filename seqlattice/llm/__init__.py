"""Operators for preparing large text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need not have the library installed: functions are shipped with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
