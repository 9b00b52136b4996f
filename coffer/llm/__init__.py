"""Operators for preparing training data at scale.

One module per operator; ``queries`` binds them to the test tables. Nothing else in the library
imports this package. Functions that run in Python workers are shipped with the job, so workers
need numpy, pyarrow and the libraries an operator names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
