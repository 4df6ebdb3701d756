"""acervo: a Spark-native engine for versioned document corpora and grounded retrieval."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a
# cluster needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
