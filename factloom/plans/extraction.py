"""Queries over threads, routing, graphs, trust policies, checks and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import extract, graph_claims, policy, render, threads
from factloom.plans.registry import query, table
from factloom.sources import turtle


@query("""WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS parent FROM conversations),
t AS (SELECT conv_id, turn, 0 AS depth, [turn] AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.conv_id, c.turn, t.depth + 1, list_append(t.path, c.turn) FROM c JOIN t ON c.conv_id = t.conv_id AND c.parent = t.turn)
SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS place FROM t""")
def thread_depth_first(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id")).distinct()
    c = c.withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 2))).withColumn("ordinal", F.col("id"))
    tree = threads.tree_paths(c)
    placed = tree.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("path", "id", "depth"))).alias("rows"))
    return placed.select(F.col("thread").alias("conv_id"), F.posexplode("rows").alias("i", "r")).select("conv_id", F.col("r.id").alias("turn"), F.col("r.depth").alias("depth"), (F.col("i") + 1).cast("long").alias("place"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS parent FROM conversations WHERE turn % 5 <> 1),
t AS (SELECT conv_id, turn FROM c WHERE parent IS NULL UNION ALL SELECT c.conv_id, c.turn FROM c JOIN t ON c.conv_id = t.conv_id AND c.parent = t.turn) SELECT conv_id, count(*) AS kept FROM t GROUP BY conv_id""")
def thread_pruned(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id")).distinct()
    c = c.withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 2))).withColumn("ordinal", F.col("id"))
    return threads.tree_paths(c, prune=F.col("id") % 5 != 1).groupBy(F.col("thread").alias("conv_id")).agg(F.count("*").alias("kept"))


_TYPES = ["REDDIT_POST", "RDF_GRAPH", "JOURNAL", "SOMETHING_ELSE"]


@query("""WITH d AS (SELECT ['REDDIT_POST', 'RDF_GRAPH', 'JOURNAL', 'SOMETHING_ELSE'][CAST(doc_id % 4 + 1 AS INT)] AS t FROM documents)
SELECT CASE WHEN t = 'SOMETHING_ELSE' THEN 'GENERAL' ELSE t END AS extractor, CASE t WHEN 'REDDIT_POST' THEN 0.4 WHEN 'RDF_GRAPH' THEN 0.6 ELSE 0.7 END::DOUBLE AS trust, count(*) AS n FROM d GROUP BY ALL""")
def extractor_routing(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, folder, "documents").select(extract.route(kind).alias("r")).groupBy("r.extractor", "r.trust").agg(F.count("*").alias("n"))


@query("""SELECT 'http://x.org/nation/' || n_nationkey AS s, 'http://x.org/region' AS p, 'http://x.org/region/' || n_regionkey AS o, n_name || ' region: ' || r_name AS content, CASE WHEN n_nationkey % 4 = 0 THEN 0.72 ELSE 0.95 END::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey""")
def rdf_graph_claims(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    rdf, label = graph_claims.RDF, graph_claims.LABELS[0]
    nation, region = F.format_string("<http://x.org/nation/%s>", F.col("n_nationkey").cast("string")), F.format_string("<http://x.org/region/%s>", F.col("n_regionkey").cast("string"))
    line = lambda *x: F.concat_ws(" ", *x, F.lit("."))
    bundle = F.format_string("_:b%s", F.col("n_nationkey").cast("string"))
    lines = n.select(line(nation, F.lit("<http://x.org/region>"), region).alias("value")).union(n.select(line(nation, F.lit(f"<{label}>"), F.format_string('"%s"@en', F.col("n_name")))))
    lines = lines.union(r.select(line(F.format_string("<http://x.org/region/%s>", F.col("r_regionkey").cast("string")), F.lit(f"<{label}>"), F.format_string('"%s"', F.col("r_name")))))
    some = n.where("n_nationkey % 4 = 0")
    for p, o in (("type", F.lit(f"<{rdf}Statement>")), ("subject", nation), ("predicate", F.lit("<http://x.org/region>")), ("object", region)):
        lines = lines.union(some.select(line(bundle, F.lit(f"<{rdf}{p}>"), o)))
    lines = lines.union(some.select(line(bundle, F.lit("<http://example.org/confidence>"), F.lit('"0.72"^^<http://www.w3.org/2001/XMLSchema#double>')))).union(n.limit(1).select(F.lit("not a triple").alias("value")))
    return graph_claims.triple_claims(graph_claims.line_triples(lines.withColumn("document", F.lit("nations")))).select("s", "p", "o", "content", "confidence")


_GRAPH = """@prefix ex: <http://x.org/customer/> . @prefix wd: <http://www.wikidata.org/entity/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>
<http://x.org/customer/> a <http://www.w3.org/2002/07/owl#Ontology> . # no claim
ex:%1$s rdfs:label "%2$s"@en ; ex:hasBalance %3$s ;; ex:livesIn wd:Q%4$s, [ rdfs:label "a home" ], [] .
wd:Q%4$s rdfs:label "Land"@de, "Nation %4$s" .
[] a rdf:Statement ; rdf:subject ex:%1$s ; rdf:predicate ex:buysFor ; rdf:object '''%5$s'''@fr ; <http://example.org/confidence> 0.72 .
<http://x.org/g> { ex:%1$s ex:knows ("x" wd:Q%4$s) } <http://x.org/g> { <http://x.org/g> <http://example.org/confidence> 0.4 . ex:%1$s ex:isKnown true } """


@query("""WITH c AS (SELECT *, 'http://x.org/customer/' AS ex, 'http://x.org/customer/' || c_custkey AS s FROM customer)
SELECT s, ex || 'hasBalance' AS p, c_name || ' has balance: ' || c_acctbal::DECIMAL(12,2) AS content, 0.95::DOUBLE AS confidence, '' AS refs FROM c
UNION ALL SELECT s, ex || 'livesIn', c_name || ' lives in: Nation ' || c_nationkey, 0.95, 'wikidata:Q' || c_nationkey FROM c UNION ALL SELECT s, ex || 'livesIn', c_name || ' lives in: a home', 0.95, '' FROM c
UNION ALL SELECT s, ex || 'buysFor', c_name || ' buys for: ' || c_mktsegment || ' (fr)', 0.72, '' FROM c UNION ALL SELECT s, ex || 'isKnown', c_name || ' is known: true', 0.4, '' FROM c""")
def turtle_claims(spark: SparkSession, folder: str) -> DataFrame:
    """A document in Turtle and TriG for each customer, read and told in words."""
    values = [F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal").cast("decimal(12,2)"), F.col("c_nationkey"), F.col("c_mktsegment")]
    docs = table(spark, folder, "customer").select(F.format_string(_GRAPH, *[v.cast("string") for v in values]).alias("body"), F.col("c_custkey").alias("document"))
    claims = graph_claims.triple_claims(turtle.read_graphs(docs, "document", "body"))
    return claims.select("s", "p", "content", "confidence", F.array_join("refs", ",").alias("refs"))


@query(r"""WITH s AS (SELECT * FROM (VALUES ('0', 'a', 0.9), ('0', 'a', 0.4), ('1', 'b', 0.7)) t(domain, st, rank)), h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]*?([a-z]+[.](com|net|org))/', 1) AS host, CAST(page_id % 3 AS VARCHAR) AS domain, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS st FROM pages),
b AS (SELECT page_id, url, host, coalesce(CASE WHEN host = 'example.com' THEN 0.3 END, min(rank), 1.0)::DOUBLE AS base FROM h LEFT JOIN s USING (domain, st) GROUP BY page_id, url, host),
c AS (SELECT *, CASE WHEN regexp_matches(url, '/(fr|en)/[0-9]') THEN -0.25 ELSE 0 END + CASE WHEN regexp_matches(url, '[13579]$') THEN -0.5 ELSE 0 END AS mine, CASE WHEN regexp_matches(url, '[13579]$') THEN -0.625 ELSE 0 END AS theirs FROM b)
SELECT page_id, greatest(0, least(1, base + CASE WHEN mine = 0 THEN theirs WHEN theirs = 0 THEN mine ELSE least(mine, theirs) END))::DOUBLE AS trust FROM c""")
def trust_lenses(spark: SparkSession, folder: str) -> DataFrame:
    """Trust of every page by two lenses: ranks, scores of hosts and what expressions take away."""
    statements = spark.createDataFrame([("0", "a", 0.9), ("0", "a", 0.4), ("1", "b", 0.7)], "domain string, source_type string, trust_rank double")
    rules = [("mine", "domain", "example.com", 0.3, None), ("theirs", "domain", "example.com", 0.8, None), ("mine", "url_pattern", "/(fr|en)/[0-9]", None, -0.25), ("mine", "url_pattern", "[13579]$", None, -0.5), ("theirs", "url_pattern", "[13579]$", None, -0.625)]
    told = spark.createDataFrame(rules, "lens string, scope string, pattern string, score double, modifier double")
    pages = table(spark, folder, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/]*?([a-z]+[.](com|net|org))/", 1).alias("host"), (F.col("page_id") % 3).cast("string").alias("domain"), F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("source_type"))
    return policy.with_trust(pages, statements, told, "url").select("page_id", "trust")


@query("""SELECT v, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text = '' THEN 'missing:content' END, CASE WHEN quality IS NULL THEN 'missing:quality' END, CASE WHEN n_chars / 5000.0 > 1 THEN 'range:confidence' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'enum:status' END], lambda x: x IS NOT NULL)) AS v
FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY v""")
def claim_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    status = F.when(F.col("lang").isin("en", "de"), "ACTIVE").otherwise("UNHEARD")
    found = policy.violations({"content": F.col("text"), "quality": F.col("quality")}, {"confidence": F.col("n_chars") / 5000.0}, {"status": status})
    return rows.select(F.explode(found).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("""SELECT source, doc_id, md5('> [!note] ' || regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') || chr(10) || '> confidence ' || format('{:.2f}', ((doc_id * 37) % 101) / 100.0)) AS line FROM documents""")
def rendered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines; rendered_documents_whole joins them to the sources' documents."""
    return _claim_lines(table(spark, folder, "documents"), F.col("text")).withColumn("line", F.md5("line"))


@query()
def rendered_documents_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of all sources, in parts: source, part, lines, document."""
    return render.document_parts(_claim_lines(table(spark, folder, "documents"), F.col("text")), ["source"], "line", ["doc_id"])


def _claim_lines(documents: DataFrame, content: Column) -> DataFrame:
    confidence = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0
    return documents.select("source", "doc_id", render.claim_line(content, F.lit("ACTIVE"), confidence, F.lit(None).cast("string")).alias("line"))


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g') AS slug FROM part), c AS (SELECT slug, count(*) AS m, count(DISTINCT p_brand) AS b, count(DISTINCT p_size) AS z FROM s GROUP BY slug)
SELECT p_partkey, CASE WHEN m = 1 THEN slug WHEN b = m THEN slug || '-' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') WHEN z = m THEN slug || '-' || p_size ELSE slug || '-' || p_partkey END AS page FROM s JOIN c USING (slug)""")
def subject_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _subject_pages(table(spark, folder, "part"))


def _subject_pages(part: DataFrame) -> DataFrame:
    rows = part.select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").cast("string").alias("key"))
    return render.subject_names(rows, "p_name", ["p_brand", "size", "key"]).select("p_partkey", "page")


@query("""SELECT field, populated, n, round(rate, 6) AS rate, rate >= 0.8 AS enough FROM (SELECT unnest(['value', 'props', 'big']) AS field, unnest([count(value), count(props), count(*) FILTER (value > 100)]) AS populated, count(*) AS n, unnest([count(value) / count(*), count(props) / count(*), count(*) FILTER (value > 100) / count(*)]) AS rate FROM events)""")
def contract_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = policy.field_statistics(table(spark, folder, "events"), {"value": F.col("value").isNotNull(), "props": F.col("props").isNotNull(), "big": F.col("value") > 100})
    return found.select("field", "populated", "n", F.round("rate", 6).alias("rate"), "enough")
