"""tabprobe: automated analysis of tabular datasets as Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame (cleaning also returns an
action table), so the work stays lazy and distributed until the caller acts.
"""

import sys as _sys

from tabprobe.session import checkpoint_dir, local_session, materialize

# The few functions that run in Python workers (workbook parsing, per-partition
# running counts) are shipped by value, so executors need no installed copy of
# this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass

__all__ = ["checkpoint_dir", "local_session", "materialize"]
