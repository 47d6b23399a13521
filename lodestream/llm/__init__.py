"""Corpus operators for training data. Nothing outside this subpackage imports it.

The modules travel to Python workers by value, so executors need no copy of
this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
