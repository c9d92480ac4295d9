"""Operators for preparing language-model training data.

The functions that run inside Spark tasks are shipped by value, so executors
need numpy, pandas and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
