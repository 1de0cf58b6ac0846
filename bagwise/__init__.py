"""Bag-level learning over weakly labelled rows, on Spark.

A *bag* is a labelled group of unlabelled rows (*instances*). Frames follow one convention:

* instances: ``bag_id``, ``instance_id``, ``features array<double>``
* bags: ``bag_id``, ``label int`` (and, where needed, ``split`` or ``fold``)

``functions`` hold column expressions, ``sources`` read and write, ``operators`` map frames to
frames, ``plans`` put them together into whole jobs.
"""

import sys

from pyspark import cloudpickle

from bagwise.session import local_session

# Functions sent to executors carry their code along: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["local_session"]
