"""Operators for preparing training corpora, with their queries. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions and classes of this folder travel to the executors with the job; they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
