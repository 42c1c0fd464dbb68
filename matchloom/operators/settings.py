"""Layered settings of centers: policy, stored and run rows resolved by key, with checks and warnings as rows.

Setting tables are small (rows a center), but they stay tables: each layer is rows, a layer replaces what a
lower one says about a center, and what comes out is joined by J18 and the student order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import Policy

#: From the weakest to the strongest.
LAYERS = ("policy", "stored", "run")


def policy_managers(spark, policy: Policy) -> DataFrame:
    """center_code, manager and position of the policy's managers."""
    rows = [(c, m, i) for c, names in policy.center_managers.items() for i, m in enumerate(names)]
    return spark.createDataFrame(rows, "center_code bigint, manager string, position int")


def resolved_managers(layers: Sequence[DataFrame], centers: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """center_code, manager, position and layer: for each center the names of the strongest layer that has any.

    ``layers`` go from weak to strong; each has center_code, manager and position. Names are trimmed, blank ones
    and rows without center do not count, a repeated name keeps its first position. ``strict`` fails if a
    center of ``centers`` other than 0 has no manager.
    """
    ranked = [
        rows.select(F.col("center_code").cast("bigint").alias("center_code"), F.trim("manager").alias("manager"), F.col("position").cast("int").alias("position"), F.lit(n).alias("layer"))
        for n, rows in enumerate(layers)
    ]
    rows = reduce(DataFrame.unionByName, ranked).where("center_code is not null and manager <> ''")
    rows = rows.groupBy("center_code", "layer", "manager").agg(F.min("position").alias("position"))
    strongest = rows.groupBy("center_code").agg(F.max("layer").alias("layer"))
    out = rows.join(strongest, ["center_code", "layer"]).select("center_code", "manager", "position", "layer")
    if strict and centers is not None:
        bare = centers.select(F.col("center_code").cast("bigint").alias("center_code")).where("center_code <> 0").distinct().join(out, "center_code", "left_anti")
        missing = [str(r[0]) for r in bare.orderBy("center_code").limit(10).collect()]
        if missing:
            raise ValueError(f"no manager for the centers {', '.join(missing)}")
    return out


def resolved_priority(layers: Sequence[DataFrame], default_center: int | None = 0) -> DataFrame:
    """center_code and priority (from 0): the centers of the strongest layer first, then what weaker ones add, then the default.

    ``layers`` go from weak to strong; each has center_code and position. A center keeps its first place.
    """
    last = len(layers)
    ranked = [rows.select(F.col("center_code").cast("bigint").alias("center_code"), F.struct(F.lit(last - n).alias("layer"), F.col("position").cast("int").alias("position")).alias("place")) for n, rows in enumerate(layers)]
    rows = reduce(DataFrame.unionByName, ranked).where("center_code is not null")
    if default_center is not None:
        tail = rows.sparkSession.range(1).select(F.lit(default_center).cast("bigint").alias("center_code"), F.struct(F.lit(last + 1).alias("layer"), F.lit(0).alias("position")).alias("place"))
        rows = rows.unionByName(tail)
    first = rows.groupBy("center_code").agg(F.min("place").alias("place"))
    # Rows a center, a handful: their rank is the number of centers before them.
    before = first.select(F.col("place").alias("other"))
    ahead = first.join(before, F.col("other") < F.col("place"), "left").groupBy("center_code").agg(F.count("other").cast("int").alias("priority"))
    return ahead.select("center_code", "priority")


def setting_warnings(managers: DataFrame, priority: DataFrame, centers: DataFrame) -> DataFrame:
    """center_code and warning: settings of centers that are not defined, and a center 0 without a priority."""
    known = centers.select(F.col("center_code").cast("bigint").alias("center_code")).distinct()
    tag = lambda df, text: df.select("center_code").distinct().withColumn("warning", F.lit(text))
    out = tag(managers.join(known, "center_code", "left_anti"), "MANAGER_OF_UNDEFINED_CENTER")
    out = out.unionByName(tag(priority.join(known, "center_code", "left_anti"), "PRIORITY_OF_UNDEFINED_CENTER"))
    return out.unionByName(tag(known.where("center_code = 0").join(priority, "center_code", "left_anti"), "CENTER_0_WITHOUT_PRIORITY"))
