"""Training-data operators: filters, dedup, classifier, scoring and packing of text corpora.

Functions that run in tasks are pickled by value, so executors need not have
this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
