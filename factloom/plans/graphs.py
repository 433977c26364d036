"""Queries over triples and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import conformance, shapes
from factloom.plans.registry import query, table
from factloom.sources.turtle import RDF, XSD

#: Shapes of an order and of its items.
ORDERS = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <urn:> .
:Order a sh:NodeShape ; sh:targetClass :order ;
  sh:property [ sh:path :status ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:in ( "F" "O" ) ] ;
  sh:property [ sh:path :total ; sh:minCount 1 ; sh:datatype xsd:float ; sh:maxInclusive 200000.0 ] ;
  sh:property [ sh:path :item ; sh:nodeKind sh:IRI ; sh:node :Item ] .
:Item a sh:NodeShape ;
  sh:property [ sh:path :quantity ; sh:minCount 1 ; sh:maxInclusive 45 ] ;
  sh:property [ sh:path :flag ; sh:pattern "^[NA]$" ; sh:severity sh:Warning ] .
"""


@query("""WITH o AS (SELECT *, o_orderkey % 13 <> 0 AS priced FROM orders), i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'Order' AS shape, 'status' AS path, 'in' AS "constraint", 'Violation' AS severity, false AS nested, count(*) AS n FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT 'Order', 'status', 'maxCount', 'Violation', false, count(*) FROM o WHERE o_orderkey % 11 = 0 AND o_orderstatus <> 'F'
UNION ALL SELECT 'Order', 'total', 'minCount', 'Violation', false, count(*) FROM o WHERE NOT priced
UNION ALL SELECT 'Order', 'total', 'datatype', 'Violation', false, count(*) FROM o WHERE priced AND o_orderkey % 7 = 0
UNION ALL SELECT 'Order', 'total', 'maxInclusive', 'Violation', false, count(*) FROM o WHERE priced AND o_totalprice > 200000
UNION ALL SELECT 'Item', 'quantity', 'maxInclusive', 'Violation', true, count(DISTINCT (l_orderkey, l_linenumber, l_quantity)) FROM i WHERE l_quantity > 45
UNION ALL SELECT 'Item', 'flag', 'pattern', 'Warning', true, count(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) FROM i WHERE l_returnflag NOT IN ('N', 'A')
UNION ALL SELECT 'Order', 'item', 'node', 'Violation', false, count(DISTINCT (l_orderkey, l_linenumber)) FROM i WHERE l_quantity > 45 OR l_returnflag NOT IN ('N', 'A')""")
def shape_violations_in_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """What orders and their items break of ORDERS; a customer's orders are one document.

    Lines with one key are one node, which then has several quantities or flags.
    """
    o, i = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    order = lambda k: F.concat(F.lit("urn:o"), F.col(k).cast("string"))
    no = F.lit(None).cast("string")

    def triple(p: str, value: Column, kind: str = "literal", datatype: Column = no) -> Column:
        return F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(kind).alias("kind"), datatype.alias("datatype"), no.alias("lang"))

    k = F.col("o_orderkey")
    price = triple("urn:total", F.col("o_totalprice"), datatype=F.when(k % 7 == 0, XSD + "decimal").otherwise(XSD + "float"))
    heads = o.select(F.col("o_custkey").cast("string").alias("document"), order("o_orderkey").alias("s"), F.explode(F.array_compact(F.array(
        triple(RDF + "type", F.lit("urn:order"), "iri"), triple("urn:status", F.col("o_orderstatus")), F.when(k % 11 == 0, triple("urn:status", F.lit("F"))), F.when(k % 13 != 0, price)))).alias("t"))
    lines = i.join(o.select(k.alias("l_orderkey"), F.col("o_custkey").cast("string").alias("document")), "l_orderkey").withColumn("item", F.concat(F.lit("urn:i"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    parts = lines.select("document", F.explode(F.array(
        F.struct(order("l_orderkey").alias("s"), triple("urn:item", F.col("item"), "iri").alias("t")), F.struct(F.col("item").alias("s"), triple("urn:quantity", F.col("l_quantity"), datatype=F.lit(XSD + "double")).alias("t")),
        F.struct(F.col("item").alias("s"), triple("urn:flag", F.col("l_returnflag")).alias("t")))).alias("x")).select("document", "x.s", "x.t")
    found = shapes.violations(heads.unionByName(parts).select("document", "s", "t.*"), shapes.rules(ORDERS))
    name = lambda c: F.replace(F.col(c), F.lit("urn:")).alias(c)
    return found.groupBy(name("shape"), name("path"), "constraint", "severity", "nested").agg(F.count("*").alias("n"))


#: What of an order has each field of the contract, in SQL; others have none.
_HAS = {
    "id": "true", "content": "o_orderpriority <> ''", "confidence.value": "o_orderkey % 9 <> 0", "provenance": "o_custkey % 4 <> 0", "asserted_by": "true", "status": "true", "schema_version": "true", "particle_type": "o_orderkey % 50 <> 0",
    "subject_ids": "o_custkey % 4 IN (1, 2)", "uncertainty_nature": "true", "confidence.calibration_source": "o_orderkey % 9 <> 0", "provenance[].snapshot_id": "o_custkey % 4 <> 0 AND o_orderkey % 6 <> 0 AND o_orderstatus <> 'P'", "extractor_ref": "o_orderkey % 3 = 0",
    "confidence.variance": "o_orderkey % 9 <> 0", "tags": "o_orderkey % 5 <> 0", "properties": "o_orderkey % 7 <> 0", "valid_until": "o_orderkey % 2 = 0", "structured_claim": "o_orderkey % 10 = 1",
}
_DISTINCT = {"status": "CASE WHEN o_orderstatus = 'F' THEN 'RETRACTED' ELSE 'ACTIVE' END", "uncertainty_nature": "'EPISTEMIC'", "particle_type": "CASE WHEN o_orderkey % 50 <> 0 THEN 'CLAIM' END", "confidence.calibration_source": "CASE WHEN o_orderkey % 9 <> 0 THEN 'DERIVED' END"}


def _contract_sql() -> str:
    each = []
    for field, tier in conformance.CONTRACT.items():
        measured = "o_orderkey % 8 <> 0" if field == "subject_ids" else "true"
        each.append(f"SELECT '{field}' AS field, '{tier}' AS tier, count(*) FILTER ({measured} AND ({_HAS.get(field, 'false')})) AS populated, count(*) FILTER ({measured}) AS total, count(*) FILTER (NOT ({measured})) AS excluded, count(DISTINCT {_DISTINCT.get(field, 'CAST(NULL AS VARCHAR)')}) AS \"distinct\" FROM orders")
    least = " ".join(f"WHEN field = '{f}' THEN {n}" for f, n in conformance.DIVERSITY.items())
    return f"""WITH r AS ({" UNION ALL ".join(each)}), p AS (SELECT *, round(populated / total, 6) AS rate, CASE tier WHEN 'OPTIONAL' THEN true WHEN 'REQUIRED' THEN populated = total ELSE populated / total >= 0.8 END AS passes FROM r)
SELECT *, NOT (passes AND tier <> 'OPTIONAL' AND "distinct" < CASE {least} ELSE 0 END) AS advised FROM p"""


@query(_contract_sql())
def contract_of_structs(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of the contract, by their paths in claims with structs, arrays of structs and maps."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    source = lambda snapshot: F.struct(F.lit("e").alias("corpus_entry_id"), snapshot.alias("snapshot_id"))
    claims = table(spark, folder, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("content"), F.when(k % 9 != 0, F.struct((c % 3).cast("double").alias("value"), F.lit("DERIVED").alias("calibration_source"), F.lit(0.0).alias("variance"))).alias("confidence"),
        F.when(c % 4 == 0, F.array().cast("array<struct<corpus_entry_id:string,snapshot_id:string>>")).otherwise(F.array(source(F.when(k % 6 != 0, "s")), source(F.when(F.col("o_orderstatus") == "P", "").otherwise("t")))).alias("provenance"),
        F.lit("me").alias("asserted_by"), F.when(F.col("o_orderstatus") == "F", "RETRACTED").otherwise("ACTIVE").alias("status"), F.lit("1.0.0").alias("schema_version"), F.when(k % 50 != 0, "CLAIM").alias("particle_type"),
        F.when(c % 4 == 0, F.array().cast("array<string>")).when(c % 4 == 1, F.array(F.lit("a"))).when(c % 4 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit(None))).alias("subject_ids"),
        F.lit("EPISTEMIC").alias("uncertainty_nature"), F.when(k % 3 == 0, F.struct(F.lit("x").alias("name"))).alias("extractor_ref"), F.when(k % 5 != 0, F.array(F.lit("t"))).alias("tags"),
        F.when(k % 7 != 0, F.create_map(F.lit("a"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>")).alias("properties"), F.when(k % 2 == 0, F.col("o_orderdate")).alias("valid_until"), F.when(k % 10 == 1, F.struct(F.lit(None).cast("string").alias("subject"))).alias("structured_claim"), "o_orderkey",
    )
    return conformance.contract_of(claims, {"subject_ids": F.col("o_orderkey") % 8 == 0}).withColumn("rate", F.round("rate", 6))
