"""Operators for training-data corpora: filters, near duplicates, mixing, sharding."""

from pyspark import cloudpickle

import helioframe.llm as _package

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(_package)
