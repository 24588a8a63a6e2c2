"""Operators for preparing training data; nothing outside this folder imports them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# The kernels travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
