"""Scans of measurement tables, robust scaling and result sinks."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import quantile, with_position


@dataclass
class Dataset:
    """points: id, features, y (-1 background)."""

    points: DataFrame
    names: list[str]
    metadata: dict = field(default_factory=dict)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their median, over 1.4826 times their median absolute deviation; a scale under 1e-8 counts as 1. Nulls and NaN are ignored in both."""
    clean = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in columns}
    medians = {c: quantile(df, clean[c], 0.5) for c in columns}
    spread = {c: quantile(df, F.abs(clean[c] - F.lit(medians[c])), 0.5) for c in columns}
    scale = {c: 1.4826 * (spread[c] or 0.0) for c in columns}
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(medians[c])) / (scale[c] if scale[c] >= 1e-8 else 1.0) for c in columns})


def label_codes(df: DataFrame, column: str, background: str) -> tuple[DataFrame, list[str]]:
    """df with y: the place of its label among the sorted labels that aren't background, else -1; and those labels."""
    names = [r[0] for r in df.where(F.col(column) != background).select(column).distinct().orderBy(column).limit(100_001).collect()]
    if len(names) > 100_000:
        raise ValueError("over 100000 labels")
    table = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "__name string, y long")
    joined = df.join(F.broadcast(table), F.col(column) == F.col("__name"), "left")
    return joined.withColumn("y", F.coalesce("y", F.lit(-1))).drop("__name"), names


def cytometry(spark: SparkSession, folder: str, *, cofactor: float, marker_classes: Sequence[str], background: str) -> Dataset:
    """Events by event_id with their populations; markers of the classes, asinh-scaled by cofactor, then robustly scaled."""
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=False)
    features, events, markers = read("features"), read("event_metadata"), read("feature_metadata")
    wanted = [r[0] for r in markers.where(F.col("marker_class").isin(*marker_classes)).select("feature").collect()]
    columns = [c for c in features.columns if c in set(wanted)]
    if not columns:
        raise ValueError("no marker of these classes")
    if features.select("event_id").join(events.select("event_id"), "event_id", "left_anti").limit(1).count() or events.select("event_id").join(features.select("event_id"), "event_id", "left_anti").limit(1).count():
        raise ValueError("features and event metadata are not aligned by event_id")
    joined = features.select("event_id", *columns).join(events.select("event_id", F.coalesce("population_id", F.lit("unlabeled")).alias("population_id")), "event_id")
    scaled = robust_scale(joined.withColumns({c: F.asinh(F.col(c).cast("double") / cofactor) for c in columns}), columns)
    if scaled.where(~_all(columns)).limit(1).count():
        raise ValueError("features must be finite")
    coded, names = label_codes(scaled, "population_id", background)
    points = with_position(coded, F.col("event_id").cast("long"), F.col("event_id"), name="id").select("id", _vector(columns), "y")
    return Dataset(points, names, {"source": "cytometry", "markers": columns, "cofactor": cofactor})


def _all(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & finite(F.col(c))
    return out


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns]).alias("features")


SKY = ("ra", "dec", "parallax", "pmra", "pmdec", "ruwe")


def star_cone(spark: SparkSession, cone: str, clusters: str, members: str, field_name: str, *, max_ruwe: float = 1.4, profile: str = "field") -> Dataset:
    """Stars of a cone, centred on the field's medians or on the catalogue's cluster; y = 0 for catalogue members.

    Rows need all measurements finite and a ruwe of max_ruwe at most; fewer than 33 raise ValueError.
    """
    if profile not in ("field", "catalog"):
        raise ValueError("profile must be 'field' or 'catalog'")
    stars = spark.read.csv(cone, header=True).select(F.col("source_id").cast("long").alias("source_id"), *[F.col(c).cast("double").alias(c) for c in SKY])
    stars = stars.where(_all(SKY) & F.col("source_id").isNotNull() & (F.col("ruwe") <= max_ruwe))
    if stars.limit(33).count() < 33:
        raise ValueError("at least 33 usable stars are needed")
    if profile == "field":
        center = {c: quantile(stars, c, 0.5) for c in SKY[:5]}
    else:
        row = spark.read.csv(clusters, header=True).where(F.col("Cluster") == field_name).first()
        if row is None:
            raise ValueError(f"{field_name!r} is not in the catalogue")
        center = {a: float(row[b]) for a, b in zip(SKY[:5], ("RA_ICRS", "DE_ICRS", "plx", "pmRA", "pmDE"), strict=True)}
    import math

    shifted = stars.withColumn("ra", (F.col("ra") - center["ra"]) * math.cos(math.radians(center["dec"])))
    shifted = shifted.withColumns({c: F.col(c) - center[c] for c in SKY[1:5]})
    scaled = robust_scale(shifted, SKY[:5])
    known = spark.read.csv(members, header=True).where(F.col("Cluster") == field_name).select(F.col("GaiaEDR3").cast("long").alias("source_id"), F.lit(0).cast("long").alias("y")).distinct()
    coded = scaled.join(known, "source_id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))
    points = with_position(coded, "source_id", name="id").select("id", _vector(SKY[:5]), "y")
    return Dataset(points, [field_name], {"source": "gaia", "profile": profile, "max_ruwe": max_ruwe})


def common_fields(cones: Sequence[str], clusters: DataFrame, members: DataFrame) -> list[str]:
    """Fields that have a cone file and rows in both catalogue tables."""
    names = clusters.select("Cluster").intersect(members.select("Cluster"))
    have = {os.path.basename(c).removeprefix("gaia_cone_").removesuffix(".csv") for c in cones}
    return sorted(r[0] for r in names.collect() if r[0] in have)


# --- sinks ----------------------------------------------------------------------------------


def write_json(value, path: str, attempts: int = 6) -> None:
    """Appears whole or not at all; a rename that fails is tried again after a pause."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    for i in range(attempts):
        try:
            os.replace(f.name, path)
            return
        except OSError:
            if i + 1 == attempts:
                raise
            time.sleep(0.05 * 2**i)


def write_state(labelled: DataFrame, path: str) -> None:
    """id, y, p as Parquet: what every metric can be computed from again. Beside it, in <path>-contingency, y, p and n of all pairs of labels, to audit it by."""
    labelled.select("id", "y", "p").write.mode("overwrite").parquet(path)
    kept = labelled.sparkSession.read.parquet(path)
    kept.groupBy("y", "p").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path.rstrip('/')}-contingency")


def check_state(spark: SparkSession, path: str) -> bool:
    """Whether the contingency beside a state is that of its rows."""
    rows = spark.read.parquet(path).groupBy("y", "p").agg(F.count("*").alias("n"))
    told = spark.read.parquet(f"{path.rstrip('/')}-contingency")
    return rows.exceptAll(told).union(told.exceptAll(rows)).limit(1).count() == 0


def fingerprint(df: DataFrame) -> str:
    """Of all rows whatever their order, and of the columns' types."""
    rows = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return hashlib.sha256(json.dumps([df.dtypes, [str(v) for v in rows]]).encode()).hexdigest()


def write_results_csv(results: DataFrame, path: str) -> None:
    """One row a job: scalar fields as they are, nested ones as JSON, by job_id."""
    flat = []
    for f in results.schema.fields:
        nested = f.dataType.typeName() in ("struct", "array", "map")
        flat.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name))
    results.select(*flat).orderBy("job_id").coalesce(1).write.mode("overwrite").csv(path, header=True)
