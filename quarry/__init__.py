"""An archive and compression engine on Spark DataFrames.

Python workers must find this package. Importing it puts its folder on the workers' path, for
sessions that are open and for ones that start later; on a cluster, install the package on the
executors or submit it with ``--py-files``.
"""

import os as _os
from pathlib import Path as _Path

_ROOT = str(_Path(__file__).resolve().parents[1])


def _reach_workers() -> None:
    from pyspark import SparkContext

    known = _os.environ.get("PYTHONPATH", "")
    if _ROOT not in known.split(_os.pathsep):
        _os.environ["PYTHONPATH"] = _os.pathsep.join([_ROOT, *filter(None, [known])])
    context = SparkContext._active_spark_context
    if context is not None:
        context.environment.setdefault("PYTHONPATH", _os.environ["PYTHONPATH"])


_reach_workers()
