"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import stage_table

#: Tasks that share the rows of a frequent key.
SALT = 64


def dealt_join(many: DataFrame, one: DataFrame, key: str, by: str, rows: int) -> DataFrame:
    """``many`` (of about ``rows`` rows) joined on ``key`` with ``one``, where each key stands once with the number n of its rows.

    Keys with more than a quarter of a task's even share are dealt over SALT tasks by the hash of ``by``;
    there are fewer than four of them a task, which bounds the list of them that is broadcast.
    """
    share = rows / (4 * max(8, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = one.where(F.col("n") > share).select(key, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALT))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("n") > share, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    salted = many.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__hot")
    return salted.join(one.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt", "n")


def star_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge with the smallest node of its component.

    Self edges give nothing.  Neighbour lists are never gathered: a node's smallest
    neighbour is an aggregate that is joined back, so a node of any degree is fine.
    """
    e = stage_table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u hang on the smallest node around u.
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u, and u, hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        e = stage_table(small.where("u != v").distinct(), "edges")
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
