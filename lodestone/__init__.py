"""lodestone: retrieval, filtering and evaluation analytics on PySpark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no installed copy: functions of this package travel with the tasks.
register_pickle_by_value(sys.modules[__name__])
