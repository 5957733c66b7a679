"""lexhoard: Spark jobs over large bibliographic, clinical-trial and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
