"""Operations of a training-data pipeline: filtering, near-duplicate removal, mixing, scoring.

Nothing outside this subpackage imports it.  Functions that run on executors are pickled by
value, but what they call may be imported there; the registered queries send the library
first (``functions.shipping``), and who calls an operator alone does the same.
"""

from __future__ import annotations

import lithograph
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(lithograph)
