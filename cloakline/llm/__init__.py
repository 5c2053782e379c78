"""Training-data operators: fingerprints, dedup, packing, scans, mixing, WARC, toxicity.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
