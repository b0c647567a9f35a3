"""Operators of a training-data pipeline: quality, personal data, near and exact
duplicates, packing, web archives, mixing and URL rules.

Nothing else in the library imports this package.  Its task functions travel to
the Python workers by value, so executors need the installed libraries but not
this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
