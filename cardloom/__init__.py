"""cardloom: Spark-native analytics over opened packs, cards, prices and scans."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
