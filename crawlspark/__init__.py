"""Crawl archiving on Spark: assemble, validate, deduplicate, file and index."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its few Python tasks carry
# their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
