"""tessera: Spark-native analytics over source repositories and text corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers carry their code along, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
