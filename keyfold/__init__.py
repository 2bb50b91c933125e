"""keyfold: keyed, versioned, merge-on-read data as declarative Spark plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__all__ = ["__version__"]
__version__ = "0.1.0"

# Functions that run on executors travel with their code, so executors need not have the package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
