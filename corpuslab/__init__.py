"""corpuslab: a Spark-native corpus build and run-analytics library."""

import sys

try:  # ship our UDF / mapInPandas functions by value, so executors need not import this package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
