"""Training-data operators: scoring, filtering, deduplication and tokenizing of text corpora.

Functions of this package that run on executors are sent to them whole, so executors need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
