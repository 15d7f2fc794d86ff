"""Code- and log-corpus analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames and serves all sessions at once.
"""

import sys

from pyspark import cloudpickle

# Ship the few Arrow helpers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
