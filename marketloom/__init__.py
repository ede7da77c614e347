"""Market-news analytics on Spark: price bars, headlines and daily sentiment as DataFrame jobs."""

import sys

from pyspark import cloudpickle

from marketloom.settings import Settings

__all__ = ["Settings"]

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
