"""Code-data generation and curation on Spark: every operator is a DataFrame function or a Column builder.

Python functions are shipped to the executors by value, so the executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
