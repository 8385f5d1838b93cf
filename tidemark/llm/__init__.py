"""Operators of a large-scale training-data pipeline.

One module per operator, each with its own general interface; ``queries``
holds the thin registered queries (``QUERIES``) and their DuckDB SQL
(``ORACLE``).  Nothing else in the library imports this subpackage.

Functions that run inside Spark's Python workers are shipped by value, so a
cluster needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
