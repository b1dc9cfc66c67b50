"""Acceptance QA/QC of line surveys on Spark: sources, window and run primitives, checks, levelling, gridding and reports."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need no copy of this package; they name functions and constants, never modules of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
