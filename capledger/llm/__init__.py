"""Training-data operators: filters, deduplication, decontamination, sharding, packing.

Python functions of this package travel to the executors by value, so that the workers
need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
