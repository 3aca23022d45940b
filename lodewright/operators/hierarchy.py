"""START WITH ... CONNECT BY: levels, paths, cycles and sibling order, level by level in the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.storage import materialize


def connect_by(rows: DataFrame, key: str, parent: str, start: Column | None = None, nocycle: bool = False, siblings: list[str] | None = None, where: Column | None = None, most: int | None = None) -> DataFrame:
    """``rows`` with level, path (keys from the root) and iscycle, in depth-first order.

    A child whose key is among its ancestors is an error, or with ``nocycle`` is left out
    and its parent flagged. ``where`` is applied after the expansion; ``most`` sets a budget
    of rows, beyond which is an error.
    """
    sibling = F.struct(*(F.col(c) for c in (siblings or [key])), F.col(key).alias("_k")).alias("_s")
    base = rows.withColumn("_sib", sibling)
    level = base.filter(start if start is not None else F.lit(True)).withColumns({"level": F.lit(1), "path": F.array(F.col(key)), "_order": F.array("_sib")})
    levels, flagged, total = [], [], 0
    while True:
        level = materialize(level, "level")
        n = level.count()
        total += n
        if not n:
            break
        if most is not None and total > most:
            raise ValueError("CONNECT BY expands to more rows than allowed")
        levels.append(level)
        above = level.select(F.col(key).alias("_pk"), F.col("level").alias("_pl"), F.col("path").alias("_pp"), F.col("_order").alias("_po"))
        children = base.join(above, base[parent] == above["_pk"])
        loops = children.filter(F.array_contains("_pp", F.col(key)))
        if not nocycle:
            if not loops.isEmpty():
                raise ValueError("CONNECT BY loop in user data")
        else:
            flagged.append(materialize(loops.select(F.col("_pp").alias("path")).distinct(), "loops"))
        fresh = children.filter(~F.array_contains("_pp", F.col(key)))
        level = fresh.select(*rows.columns, "_sib", (F.col("_pl") + 1).alias("level"), F.concat("_pp", F.array(F.col(key))).alias("path"), F.concat("_po", F.array("_sib")).alias("_order"))
    if not levels:
        return rows.limit(0).withColumns({"level": F.lit(1), "path": F.array(F.col(key)), "iscycle": F.lit(0)})
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    if flagged:
        marks = flagged[0]
        for more in flagged[1:]:
            marks = marks.unionByName(more)
        every = every.join(marks.withColumn("iscycle", F.lit(1)), "path", "left").fillna({"iscycle": 0})
    else:
        every = every.withColumn("iscycle", F.lit(0))
    every = every.filter(where) if where is not None else every
    return every.orderBy("_order").select(*rows.columns, "level", "path", "iscycle")
