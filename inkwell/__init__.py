"""Inkwell: document analytics, retrieval and feedback learning as Spark plans."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
