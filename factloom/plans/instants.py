"""Queries over many instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import identity, instants
from factloom.plans.registry import query, table

_CLAIMS = """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate AS asserted_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes, CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS stored,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 365 DAY END AS valid_until FROM orders), s AS (SELECT supersedes AS claim_id, min(asserted_at) AS successor_at FROM c WHERE supersedes IS NOT NULL GROUP BY 1),
r AS (SELECT c.*, coalesce(stored, successor_at, valid_until) AS retired FROM c LEFT JOIN s USING (claim_id))"""


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    claims = table(spark, folder, "orders").select(
        k.alias("claim_id"), "o_custkey", "o_orderstatus", "o_totalprice", at.alias("asserted_at"), F.when(k % 3 == 0, k - 1).alias("supersedes"), F.when(k % 17 == 0, at + F.expr("INTERVAL 30 DAYS")).alias("stored_retired_at"),
        F.when(k % 5 == 0, at + F.expr("INTERVAL 365 DAYS")).alias("valid_until"),
    )
    return identity.with_retirement(claims)


@query(f"""{_CLAIMS} SELECT l_orderkey, l_linenumber, claim_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN r ON r.o_custkey = orders.o_custkey AND asserted_at <= l_shipdate AND (retired IS NULL OR retired > l_shipdate)""")
def claims_at_instants(spark: SparkSession, folder: str) -> DataFrame:
    """The claims about a customer that stood when each of their items was shipped."""
    own = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    shipped = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(own, "l_orderkey")
    met = instants.visible_at_instants(_claims(spark, folder).select("claim_id", "o_custkey", "asserted_at", "retired_at"), shipped, "l_shipdate", ("o_custkey",))
    return met.select("instant.l_orderkey", "instant.l_linenumber", "claim.claim_id")


@query(f"""{_CLAIMS}, d AS (SELECT DISTINCT l_shipdate AS day, o_orderstatus FROM lineitem, (SELECT DISTINCT o_orderstatus FROM orders))
SELECT day, d.o_orderstatus, count(claim_id) AS visible, round(coalesce(sum(o_totalprice::DECIMAL(18, 4)), 0)::DOUBLE, 4) AS total FROM d LEFT JOIN r ON r.o_orderstatus = d.o_orderstatus AND asserted_at <= day AND (retired IS NULL OR retired > day) GROUP BY 1, 2""")
def claims_standing_each_day(spark: SparkSession, folder: str) -> DataFrame:
    """How many claims of each status stood on each day of a shipment, and what they are worth."""
    status = F.explode(F.array(*map(F.lit, ("F", "O", "P")))).alias("o_orderstatus")
    days = table(spark, folder, "lineitem").select(F.col("l_shipdate").alias("day")).distinct().select("day", status)
    out = instants.visible_counts(_claims(spark, folder), days, "day", ("o_orderstatus",), "o_totalprice")
    return out.withColumn("total", F.round("total", 4))
