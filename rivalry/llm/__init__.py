"""Operations of a training-data pipeline: near-duplicate detection, scoring,
language identification, tokenisation, archive files, search and mixing.

Nothing else in the library imports this package; it only borrows the
lineage cut and the checkpoint folder of ``rivalry.session``. Its functions
travel to the executors by value, so that these need numpy, pandas and
pyarrow but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
