"""One key for every spelling of an instance identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: organisation (or benchmark prefix), project, number; the version tag behind them doesn't count.
_SHAPE = r"^(.+?)(?:__|/)(.+?)[-#]0*(\d+)(?:-v(?:[0-9a-f]+|nan))?$"


def instance_key(col: Column) -> Column:
    """`Instance_Org/proj#12-vab12 ` and `org__proj-12` give `org|proj|12`.

    Letter case, outer white space, the `instance_` prefix, the separators and a trailing version tag don't count.
    A string of another shape is its own key (trimmed, lower case); null and blank strings give null.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"^instance_", "")
    parts = [F.regexp_extract(bare, _SHAPE, i) for i in (1, 2, 3)]
    return F.when(bare == "", None).when(parts[2] != "", F.concat_ws("|", *parts)).otherwise(bare)
