"""Operators for training data at corpus scale; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# functions go to the workers by value, so that they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
