"""pagefold: web-page extraction and crawl analytics as Spark jobs.

Functions that run inside Spark tasks (the Arrow extraction pass, the streaming
limiters) live in this package. It is registered with cloudpickle *by value*, so
executors receive the code with the task and do not need the package installed.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
