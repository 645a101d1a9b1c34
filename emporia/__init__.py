"""Order, stock and cart analytics on Spark.

Every job is a function from DataFrame(s) to a DataFrame built with the
DataFrame API; only order-dependent folds that have no closed form drop to
Arrow-batched Python (``mapInPandas``) or to Structured Streaming state.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python code shipped to executors (Arrow kernels, stateful processors) is
# pickled by value, so executors do not need this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
