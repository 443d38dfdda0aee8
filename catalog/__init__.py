"""The registered queries with the SQL that checks them, and the tables both start from."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
