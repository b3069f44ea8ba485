"""What changed between consecutive full snapshots, by signed cells.

Every snapshot is unpivoted into cells (record, field, value) and a presence marker for each record. The cells of a snapshot
count +1 in the change that leads to it and -1 in the change that leads away from it; what stays cancels out in the sum, and
what is left over says which records were added, removed or changed, and in which fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRESENT = ""


def snapshot_changes(df: DataFrame, entity: list[str], snapshot: str, record: list[str], fields: dict[str, Column]) -> DataFrame:
    """(entity..., snapshot, record..., change, fields): against the entity's delivered snapshot before.

    ``change`` is added, removed or changed; ``fields`` lists, in order, the fields that differ (empty for added and
    removed). Repeated rows count once, null is a value of its own, the first snapshot of an entity gives nothing. A record
    that a snapshot holds with several values differs from one that holds fewer of them. Rows without a snapshot are left
    out; null entities and records are keys like any other. An empty table gives no rows.
    """
    keys = [*entity, snapshot]
    names = {k: f"k{i}" for i, k in enumerate([*entity, snapshot, *record])}
    rows = df.where(F.col(snapshot).isNotNull()).select(
        *(F.col(k).alias(n) for k, n in names.items()), *(c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values()))
    )
    e, s, r = [names[k] for k in entity], names[snapshot], [names[k] for k in record]
    states = rows.select(*e, s).distinct().withColumn("next", F.lead(s).over(Window.partitionBy(*e).orderBy(s))).withColumn(
        "first", F.row_number().over(Window.partitionBy(*e).orderBy(s)) == 1
    )
    rows, states = rows.alias("r"), states.alias("s")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in e] + [F.col(f"r.{s}") == F.col(f"s.{s}")]
    values = [f"f{i}" for i in range(len(fields))]
    move = F.array_compact(
        F.array(
            F.when(~F.col("s.first"), F.struct(F.col(f"r.{s}").alias("to"), F.lit(1).alias("sign"))),
            F.when(F.col("s.next").isNotNull(), F.struct(F.col("s.next").alias("to"), F.lit(-1).alias("sign"))),
        )
    )
    moves = rows.join(states, on).select(*(f"r.{k}" for k in [*e, *r, *values]), F.explode(move).alias("m")).select(*e, *r, "m.to", "m.sign", *values)
    cell = [F.struct(F.lit(-1).alias("field"), F.lit(PRESENT).alias("value"))] + [
        F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("value")) for i in range(len(fields))
    ]
    cells = moves.select(*e, *r, "to", "sign", F.explode(F.array(*cell)).alias("c")).select(*e, *r, "to", "sign", "c.field", "c.value")
    # repeated rows count once: a cell is in the state before, in the state after, or in both
    left = (
        cells.groupBy(*e, *r, "to", "field", "value")
        .agg((F.max(F.when(F.col("sign") > 0, 1).otherwise(0)) - F.max(F.when(F.col("sign") < 0, 1).otherwise(0))).alias("sum"))
        .where(F.col("sum") != 0)
    )
    marker = F.max(F.when(F.col("field") == -1, F.col("sum")))
    told = left.groupBy(*e, *r, "to").agg(marker.alias("marker"), F.sort_array(F.collect_set(F.when(F.col("field") >= 0, F.col("field")))).alias("which"))
    labels = F.array(*(F.lit(f) for f in fields))
    return told.select(
        *(F.col(names[k]).alias(k) for k in entity), F.col("to").alias(snapshot), *(F.col(names[k]).alias(k) for k in record),
        F.when(F.col("marker") > 0, "added").when(F.col("marker") < 0, "removed").otherwise("changed").alias("change"),
        F.when(F.col("marker").isNull(), F.transform("which", lambda i: F.get(labels, i))).otherwise(F.array().cast("array<string>")).alias("fields"),
    )


def redelivered_changes(df: DataFrame, record: list[str], load: str, value: str, least: float) -> DataFrame:
    """(record..., load, difference): records that came again, in a later load, with a value that differs by ``least`` or more.

    Compared with the load before that held the record. The signed cells of a change are numbers here, +new and -old, whose
    sum must reach ``least``; null against a value has no difference. Repeated rows count once; should a load hold a record
    with several values, the greatest counts. ``least`` is met exactly at 8 decimals. Rows without a load are left out.
    """
    rows = df.where(F.col(load).isNotNull()).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(record)), F.col(load).alias("load"), F.col(value).cast("double").alias("value"))
    keys = [f"k{i}" for i in range(len(record))]
    states = rows.groupBy(*keys, "load").agg(F.max("value").alias("value"))
    signed = states.withColumn("next", F.lead("load").over(Window.partitionBy(*keys).orderBy("load"))).withColumn(
        "first", F.row_number().over(Window.partitionBy(*keys).orderBy("load")) == 1
    ).where(~F.col("first") | F.col("next").isNotNull())
    cells = signed.select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("first"), F.struct(F.col("load").alias("to"), F.col("value").alias("cell"))),
                    F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("to"), (-F.col("value")).alias("cell"))),
                )
            )
        ).alias("c"),
    ).select(*keys, "c.*")
    sums = cells.groupBy(*keys, "to").agg(F.sum("cell").alias("difference"), F.count("cell").alias("n"))
    return sums.where((F.col("n") == 2) & (F.round(F.abs("difference"), 8) >= least)).select(
        *(F.col(f"k{i}").alias(k) for i, k in enumerate(record)), F.col("to").alias(load), "difference"
    )
