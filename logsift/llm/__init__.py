"""Operators for large training-data corpora (deduplication, packing, scoring, sharding, search).

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; intermediate tables go to the shared folder the cluster
names in ``spark.checkpoint.dir``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
