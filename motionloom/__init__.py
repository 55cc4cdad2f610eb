"""Motion analytics on Spark: images and detections to trajectories, cleaning, observables."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Kernels then travel with the plan: executors need no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
