"""catalign: harmonise item catalogues on Spark.

Ingest heterogeneous sources, normalise and render items to text, match items
across datasets by exact cosine similarity, transfer facts from matches and
impute the remaining gaps from nearest donors.  Everything is DataFrame code.
"""

import sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the similarity
# cell, model-call batches) are shipped with the task by value, so executors
# need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing on workers
    pass
