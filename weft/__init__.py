"""weft: a Spark-native engine for streaming intelligence data."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need not have the package installed: its functions travel with the tasks.
register_pickle_by_value(sys.modules[__name__])
