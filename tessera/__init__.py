"""tessera: corpus preparation and corpus analytics as Spark plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Executors need not have this repository on their path: functions sent to them
# carry their code with them.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
