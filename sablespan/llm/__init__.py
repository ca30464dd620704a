"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  The functions that run inside Python workers
are shipped with their code, so executors need no copy of the package on their path.
"""

from pyspark import cloudpickle

import sablespan.llm as _self

cloudpickle.register_pickle_by_value(_self)
