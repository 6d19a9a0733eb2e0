"""Operators of a training-data pipeline: license and secret scans, quality rules,
near-duplicate and repeated-passage removal, language identification, mixing,
language-model scoring, packing and nearest-neighbour search.

Python code of this subpackage is pickled by value with the functions that use it, so
executors need no install; models go to tasks in those functions' closures, which Spark
broadcasts by itself when they are large.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
