"""Network-traffic anomaly analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions and state processors travel to the executors by value, so that these need
# numpy and pyarrow but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
