"""Market-panel analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that use them, so that executors need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
