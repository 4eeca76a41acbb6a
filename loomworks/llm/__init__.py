"""Training-data operators: joins of near copies, vector search, sharding, scans, mixing, packing, archives.

Nothing else in the library imports this subpackage; it can be removed whole.  Its Python functions are
shipped to the executors by value, so the executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
