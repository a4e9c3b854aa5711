"""Microstructure analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the package's kernels inside the serialised tasks, so executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
