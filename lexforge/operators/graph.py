"""Graph operators: replacement routes, surface authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a replacement route; longer ones are reported as invalid.
MOST_STEPS = 20


def replacement_routes(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, status, depth, targets) of every start: where its replacements lead.

    nodes (id, kind, active), edges (src, dst), start (id). Routes stop at active nodes. Status, the worst
    first: TYPE_MISMATCH an active target of another kind, CYCLE_OR_INVALID a route that returns or never
    ends or a missing node, then NO_ACTIVE, MULTIPLE or UNIQUE. Breadth-first by equi-joins, one round a
    step, until no route is open.
    """
    kinds = nodes.select("id", "kind")
    open_ = start.join(kinds, "id").select("id", "kind", F.col("id").alias("at"), F.array("id").alias("path"))
    ended = None
    for _ in range(MOST_STEPS):
        step = open_.join(edges, open_["at"] == edges["src"], "left").select("id", "kind", "path", F.col("dst").alias("at"))
        known = step.join(nodes.select(F.col("id").alias("at"), F.col("kind").alias("to_kind"), "active"), "at", "left").select("id", "kind", "path", "at", "to_kind", "active")
        state = (
            F.when(F.col("at").isNull(), "dead_end").when(F.array_contains("path", F.col("at")), "cycle").when(F.col("to_kind").isNull(), "missing")
            .when(F.col("active") & (F.col("to_kind") != F.col("kind")), "mismatch").when(F.col("active"), "target").otherwise("open")
        )
        known = known.withColumn("state", state)
        done = known.where("state <> 'open'").select("id", "state", "at", F.size("path").alias("depth"))
        ended = done if ended is None else ended.unionByName(done)
        open_ = known.where("state = 'open'").select("id", "kind", "at", F.array_append("path", F.col("at")).alias("path")).checkpoint()
        if open_.isEmpty():
            break
    ended = ended.unionByName(open_.select("id", F.lit("cycle").alias("state"), "at", F.size("path").alias("depth")))
    has = lambda s: F.bool_or(F.col("state") == s)
    targets = F.array_sort(F.collect_set(F.when(F.col("state") == "target", F.col("at"))))
    out = ended.groupBy("id").agg(has("mismatch").alias("mismatch"), (has("cycle") | has("missing")).alias("cycle"), targets.alias("targets"), F.min(F.when(F.col("state") == "target", F.col("depth"))).alias("depth"))
    status = F.when(F.col("mismatch"), "TYPE_MISMATCH").when(F.col("cycle"), "CYCLE_OR_INVALID").when(F.size("targets") == 0, "NO_ACTIVE").when(F.size("targets") > 1, "MULTIPLE").otherwise("UNIQUE")
    return out.select("id", status.alias("status"), "depth", "targets")


def authority(surfaces: DataFrame) -> DataFrame:
    """surface, id, status of surfaces (surface, id, canonical): canonical owners outrank the others; a surface of
    two canonical owners, or of two others without a canonical one, is ambiguous and resolves to none."""
    by = Window.partitionBy("surface")
    any_canonical = F.max(F.col("canonical").cast("int")).over(by) == 1
    kept = surfaces.distinct().withColumn("any", any_canonical).where("canonical or not any")
    owners = kept.groupBy("surface").agg(F.countDistinct("id").alias("owners"), F.min("id").alias("id"), F.bool_or("canonical").alias("canonical"))
    one = F.col("owners") == 1
    return owners.select("surface", F.when(one, F.col("id")).alias("id"), F.when(~one, "ambiguous").when(F.col("canonical"), "canonical").otherwise("fallback").alias("status"))
