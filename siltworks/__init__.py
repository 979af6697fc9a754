"""siltworks: repository-risk and text analytics on PySpark.

Python workers may run where this package isn't installed, so functions of it
travel to them by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
