"""ruleweave: declarative content scanning as ordinary Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .engine import RuleSet, compile, compile_str  # noqa: E402

__all__ = ["RuleSet", "compile", "compile_str"]
__version__ = "0.1.0"
