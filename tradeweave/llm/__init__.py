"""Training-data operators: scoring, filtering, deduplication, search and mixing.

Nothing outside this subpackage imports it. Its functions are sent to Python
workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
