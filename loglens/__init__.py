"""A PySpark-native engine for AI-assistant and coding-agent activity logs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
