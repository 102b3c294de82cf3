"""Market analytics for whole universes of symbols, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions given to Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
