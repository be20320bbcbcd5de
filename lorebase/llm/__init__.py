"""Training-data operators. Nothing outside this subpackage and corpus_pipeline.py imports it.

Their task functions travel with the tasks, so executors need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
