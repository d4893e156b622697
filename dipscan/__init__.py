"""Periodic-dip search over large collections of brightness time series, as Spark jobs."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: functions sent to Python workers carry this package's code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
