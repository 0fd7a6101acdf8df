"""Semantic retrieval and citation-grounded answering as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The package's functions travel to the executors by value, so a session needs
# neither an installed copy there nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
