"""Training-data preparation operators: deduplication, sharding, tokenizing, mixing, filtering.

Each operator is one module with a general interface on DataFrames; ``queries`` binds the operators to the driver's
tables.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Workers get the operators' functions with the task, so they need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
