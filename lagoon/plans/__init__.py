"""Reusable physical shapes: skew-safe ranking, per-viewer top-k, round loops.

Functions that run inside tasks travel by value, so executors need no copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
