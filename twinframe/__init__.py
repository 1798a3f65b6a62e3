"""Make and judge synthetic copies of mixed numeric/categorical tables on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers carry their code along, so that executors need
# no copy of this package.
register_pickle_by_value(sys.modules[__name__])
