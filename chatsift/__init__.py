"""chatsift: chat-intent analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from chatsift.config import INTENTS, PolicyParams

# functions sent to Python workers travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["INTENTS", "PolicyParams"]
