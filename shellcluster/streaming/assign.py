"""An extension: rows that arrive in a stream are given the label of the core row whose radius they lie in.

The fitted clusters stay as they are; nothing is learnt from the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(arriving: DataFrame, cores: DataFrame, cell: float) -> DataFrame:
    """arriving (a stream or table): id, features; cores: label, features, radius of `cell` at most. id, label and ratio of each candidate.

    A stream-static equi-join on cells in up to two dimensions; the caller keeps the smallest ratio of an
    id, in a stream by foreachBatch. Rows within no radius have no row.
    """
    if cell <= 0:
        raise ValueError("cell must be positive")
    place = lambda c, i: F.floor(F.get(c, F.lit(i)).cast("double") / cell).cast("long")
    around = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = cores.withColumn("s", F.explode(around)).select("label", "radius", F.col("features").alias("core"), (place(F.col("features"), 0) + F.col("s.i")).alias("x"), F.coalesce(place(F.col("features"), 1) + F.col("s.j"), F.col("s.j")).alias("y"))
    rows = arriving.withColumns({"x": place(F.col("features"), 0), "y": F.coalesce(place(F.col("features"), 1), F.lit(0).cast("long"))})
    square = F.aggregate(F.zip_with("features", "core", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    return rows.join(near, ["x", "y"]).withColumn("ratio", F.sqrt(square) / F.col("radius")).where(F.col("ratio") <= 1).select("id", "label", "ratio")
