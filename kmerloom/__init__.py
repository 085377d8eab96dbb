"""kmerloom: set-similarity analytics over sequences, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code along, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
