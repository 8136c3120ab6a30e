"""Spanloom: sensitive-span extraction, resolution, redaction and reporting over Spark DataFrames."""

from pyspark import cloudpickle

import spanloom as _self

# Python kernels travel to executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
