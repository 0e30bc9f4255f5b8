"""Shape measurement of three-dimensional image stacks as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from voxelgrain.session import get_session, materialize

# task functions travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "materialize"]
