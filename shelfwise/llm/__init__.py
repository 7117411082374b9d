"""Training-data operators: token statistics, language ID, chat formatting,
packing, quality rules, mixing, HTML extraction, fingerprints, near-duplicate
detection, sharding, ranked search, spelling variants and a quality model.

Python code of this subpackage that runs inside tasks is shipped with the
task (pickled by value), so executors need Spark and numpy but no installed
copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
