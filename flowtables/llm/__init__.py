"""Operators for training-data pipelines: deduplication, packing, tokenising, language, secrets and formatting."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that these need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
