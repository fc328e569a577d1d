"""Annotation-data analytics on Spark: DataFrame operators over tasks, spans, candidates, reviews, corpora and run events."""

import sys

from pyspark import cloudpickle

# Functions shipped to tasks travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
