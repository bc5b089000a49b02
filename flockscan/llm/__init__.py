"""Operators and pipeline stages for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Executors receive the functions of these modules with the plan; they need no copy of them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
