"""Training-data operators.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
