"""Operators that prepare grounding samples and annotation documents as training text."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the query, so no package need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
