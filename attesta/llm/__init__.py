"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage with their code, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
