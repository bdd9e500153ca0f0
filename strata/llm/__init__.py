"""Operators of a training-data pipeline: deduplication, fingerprints, archives,
sharding, mixing, personal data, decontamination, URL rules, toxicity, collocations,
packing and conversation repair.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
