"""albumweave: a PySpark engine that turns the faces of event photos into person albums."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the workers by value, so that the workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
