"""Text-analytics jobs on document tables, as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so that
# executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
