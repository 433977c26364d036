"""Queries over structure, conformance, policies, passes, catalogues and interchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import confidence, sites
from factloom.functions import structure as st
from factloom.operators import catalogues, conformance, passes, render, replies, scoring
from factloom.operators.shared import bounded_batches, shared_folder
from factloom.plans.registry import query, table
from factloom.sources import bundles, interchange

_NOW = "1998-09-01"
#: Units that a task writes, about.
_UNITS_PER_MEMBER = 20_000


def _text(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _at(x: str) -> Column:
    return F.lit(x).cast("timestamp")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'URI' ELSE 'TOKEN' END AS s_kind, CASE WHEN o_orderkey % 2 = 0 THEN 'http://x.org/' || o_orderkey ELSE 'Name ' || o_orderkey END AS s,
 CASE WHEN o_orderkey % 3 = 0 THEN 'URI' ELSE 'TOKEN' END AS p_kind, CASE WHEN o_orderkey % 5 = 0 THEN 'TOKEN' ELSE 'LITERAL' END AS o_kind, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'xsd:decimal' END AS datatype, CASE WHEN o_orderkey % 5 = 3 THEN 'de' END AS language
FROM orders WHERE o_orderkey % 7 <> 0""")
def triples_read(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    subject = F.when(k % 2 == 0, F.concat(F.lit("http://x.org/"), _text(k))).otherwise(F.concat(F.lit("  Name "), _text(k), F.lit(" ")))
    predicate = F.when(k % 3 == 0, "foaf:knows").otherwise("knows")
    value = F.when(k % 7 == 0, " ").otherwise(_text("o_totalprice"))
    typed = F.struct(value.alias("value"), F.when(k % 5 == 0, "token").otherwise("LITERAL").alias("kind"), F.when((k % 5).isin(1, 2), "xsd:decimal").alias("datatype"), F.when(k % 5 != 1, "de").alias("language"))
    plain = F.to_json(F.struct(subject.alias("subject"), predicate.alias("predicate"), value.alias("object")))
    raw = F.when(k % 5 == 4, plain).otherwise(F.to_json(F.struct(subject.alias("subject"), predicate.alias("predicate"), typed.alias("object"))))
    rows = table(spark, folder, "orders").select(k.alias("k"), F.explode(F.array_compact(F.array(st.triple(raw, "reader", "1.0.0", ("foaf",))))).alias("t"))  # fields of one row, not six copies of its expression
    return rows.select("k", F.col("t.subject.kind").alias("s_kind"), F.col("t.subject.value").alias("s"), F.col("t.predicate.kind").alias("p_kind"), F.col("t.object.kind").alias("o_kind"), "t.object.datatype", "t.object.language")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'id1' WHEN 1 THEN 'id2' WHEN 2 THEN 'id1' END AS subject_id FROM orders""")
def subjects_bound(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    subject = F.struct(F.when(k == 1, "URI").otherwise("TOKEN").alias("kind"), F.when(k == 0, " ALPHA").when(k == 1, "http://x/beta").when(k == 2, "alpha").otherwise("gamma").alias("value"))
    names, ids = F.array(F.lit("Alpha "), F.lit("Beta"), F.lit("Gamma")), F.array(F.lit("id1"), F.lit("id2"))
    refs = F.create_map(F.lit("Beta"), F.lit("http://x/beta"), F.lit("Alpha "), F.lit("http://x/alpha"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), st.bound_subject(subject, names, ids, refs).alias("subject_id"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS stance, CASE WHEN doc_id % 3 = 0 THEN 'h' || doc_id END AS holder, CASE WHEN doc_id % 4 = 0 THEN ((doc_id * 37) % 101) / 100.0 END AS magnitude, lang = 'en' AS exempt,
 CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'observe' ELSE 'source_exempt' END END AS action, doc_id % 6 = 0 AS own FROM documents""")
def stance_and_scope(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    number = F.pmod(k * 37, F.lit(101)) / 100.0
    said = F.concat(F.lit('{"stance:holder": '), F.when(k % 3 == 0, F.concat(F.lit('"h'), _text(k), F.lit('"'))).when(k % 3 == 1, "7").otherwise('""'), F.lit(', "stance:magnitude": '), F.when(k % 4 == 0, _text(number)).when(k % 4 == 1, "true").otherwise("null"), F.lit("}"))
    marked = F.map_from_entries(F.filter(F.array(F.when(k % 5 == 0, F.struct(F.lit(st.SCOPE), F.lit("DOCUMENT_META"))), F.when((k % 5 == 0) & (k % 2 == 0), F.struct(F.lit(st.SCOPE_ACTION), F.lit("observe")))), lambda e: e.isNotNull()))
    own = st.self_scope(F.when(k % 2 == 0, "self").otherwise("WORLD"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))
    return table(spark, folder, "documents").select(
        "doc_id", st.has_stance(said).alias("stance"), st.holder(said).alias("holder"), st.magnitude(said).alias("magnitude"), st.exempt_source(F.array("lang", "source"), ("en",)).alias("exempt"),
        F.try_element_at(st.with_exemption(marked), F.lit(st.SCOPE_ACTION)).alias("action"), own.isNotNull().alias("own"),
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS item, CASE WHEN doc_id % 3 = 0 THEN 'home.org' WHEN doc_id % 3 = 1 THEN 'view.org' END AS instance, CASE WHEN doc_id % 3 = 0 THEN 'me@home.org' WHEN doc_id % 3 = 1 THEN 'me' END AS account,
 'repo' || doc_id AS repo, CASE WHEN doc_id % 2 = 0 THEN 'a/b.py' END AS path, CAST(make_date(2020 + CAST(doc_id % 4 AS INT), 1 + CAST(doc_id % 12 AS INT), 5) AS DATE) AS day, 'https://www.reddit.com/r/x/comments/p' || doc_id || '/' || CASE WHEN doc_id % 2 = 0 THEN 'slug/' ELSE '' END AS permalink FROM documents""")
def site_addresses(spark: SparkSession, folder: str) -> DataFrame:
    k, name = F.col("doc_id"), _text("doc_id")
    item = F.when(k % 4 == 0, F.concat(F.lit("https://news.ycombinator.com/item?x=1&id="), name)).when(k % 4 == 2, F.concat(F.lit("https://hacker-news.firebaseio.com/v0/item/"), name, F.lit(".json"))).otherwise(F.concat(F.lit("https://x.org/item?id="), name))
    status = F.when(k % 3 == 0, F.concat(F.lit("https://view.org/@me@home.org/"), name)).when(k % 3 == 1, F.concat(F.lit("https://view.org/@me/"), name, F.lit("?x"))).otherwise("https://view.org/about")
    file = F.when(k % 2 == 0, F.concat(F.lit("https://raw.githubusercontent.com/me/repo"), name, F.lit("/main/a/b.py?raw=1"))).otherwise(F.concat(F.lit("https://github.com/me/repo"), name, F.lit("/")))
    dated = F.concat(F.lit("https://me.github.io/"), _text(2020 + k % 4), F.lit("/"), F.lpad(_text(1 + k % 12), 2, "0"), F.lit("/05/post"))
    post = F.concat(F.lit("https://old.reddit.com/r/x/comments/p"), name, F.when(k % 2 == 0, "/slug/c1/?x=1#y").otherwise("?z"))
    route, repo = sites.status_route(status), sites.repository(sites.from_raw(file))
    return table(spark, folder, "documents").select("doc_id", sites.item_id(item).alias("item"), route["instance"].alias("instance"), route["account"].alias("account"), repo["repo"].alias("repo"), repo["path"].alias("path"), sites.day_in_path(dated).alias("day"), sites.forum_permalink(post).alias("permalink"))


@query("""SELECT doc_id, array_to_string(list_distinct([x]), ',') AS subjects, 'see @me' || doc_id || '!' AS content FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'github:me' || doc_id WHEN 1 THEN 'u/me' || doc_id ELSE 'r/me' || doc_id END AS x FROM documents)""")
def subjects_marked(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("me"), _text("doc_id"))
    kind = F.col("doc_id") % 3
    text = F.concat(F.when(kind == 0, "gh/").when(kind == 1, "u/").otherwise("r/"), name, F.lit(": hello"))
    known = {k: sites.mentioned(F.array(text), k) for k in ("gh", "u", "r")}
    subjects = F.array(name, F.when(kind == 0, F.concat(F.lit("gh/"), name)).otherwise(name), F.lit(""))
    found = sites.marked_names(subjects, known, {"gh": "github:"})
    return table(spark, folder, "documents").select("doc_id", F.array_join(found, ",").alias("subjects"), sites.mentions_written_out(F.concat(F.lit("see gh/"), name, F.lit("!"))).alias("content"))


@query("""WITH r AS (SELECT doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id)), f AS (
SELECT 'content' AS field, 'REQUIRED' AS tier, count(*) FILTER (text <> '') AS populated, count(*) AS total, 0 AS excluded, 0 AS distinct_values FROM r
UNION ALL SELECT 'uncertainty_nature', 'REQUIRED', count(*), count(*), 0, count(DISTINCT doc_id % 1) FROM r
UNION ALL SELECT 'subject_ids', 'REQUIRED', count(*) FILTER (lang <> 'de' AND lang <> ''), count(*) FILTER (lang <> 'de'), count(*) FILTER (lang = 'de'), 0 FROM r
UNION ALL SELECT 'extractor_ref', 'RECOMMENDED', count(quality), count(*), 0, 0 FROM r
UNION ALL SELECT 'tags', 'OPTIONAL', 0, count(*), 0, 0 FROM r)
SELECT field, tier, populated, total, excluded, round(populated / total, 6) AS rate, CASE tier WHEN 'OPTIONAL' THEN true WHEN 'REQUIRED' THEN populated = total ELSE populated / total >= 0.8 END AS passes, NOT (field = 'uncertainty_nature' AND distinct_values < 2) AS advised FROM f""")
def contract_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    tags = F.array().cast("array<string>")
    fields = {"content": conformance.populated(F.col("text"), "text"), "uncertainty_nature": F.lit(True), "subject_ids": F.col("lang") != "", "extractor_ref": conformance.populated(F.col("quality")), "tags": conformance.populated(tags, "list")}
    found = conformance.field_report(rows, fields, {"uncertainty_nature": F.lit("EPISTEMIC")}, {"subject_ids": F.col("lang") == "de"})
    return found.select("field", "tier", "populated", "total", "excluded", F.round("rate", 6).alias("rate"), "passes", "advised")


@query("""SELECT v, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text = '' THEN 'content:length' END, CASE WHEN n_chars / 9000.0 > 1 THEN 'confidenceValue:range' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'status:in' END,
 CASE WHEN doc_id % 2 = 0 THEN 'schemaVersion:pattern' END, 'assertedAt:missing'], lambda x: x IS NOT NULL)) AS v FROM documents) GROUP BY v""")
def shape_violations(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("lang").isin("en", "de"), "ACTIVE").otherwise("UNHEARD")
    version = F.when(F.col("doc_id") % 2 == 0, "1.0").otherwise("1.0.0")
    found = conformance.shape_violations("claim", {"id": _text("doc_id"), "content": F.col("text"), "confidenceValue": F.col("n_chars") / 9000.0, "uncertaintyNature": F.lit("ALEATORY"), "assertedBy": F.lit("x"), "status": status, "schemaVersion": version})
    return table(spark, folder, "documents").select(F.explode(found).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT o_custkey AS query_id, o_orderkey AS item FROM orders), f AS (SELECT o_custkey AS query_id, o_orderkey AS item FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT query_id, count(*) FILTER (f.item IS NULL) AS missing, count(*) FILTER (f.item IS NULL) = 0 AS passes FROM q LEFT JOIN f USING (query_id, item) GROUP BY query_id""")
def expected_in_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_orderpriority")
    return conformance.holds_expected(rows.where("o_orderpriority <> '1-URGENT'"), rows.select("query_id", "item"), "query_id", "item")


@query("""SELECT sha256(list_reduce(list(encode('f' || lpad(n_nationkey::VARCHAR, 2, '0')) || '\\x00'::BLOB || encode(n_name) || '\\x00'::BLOB || encode('{"r":' || n_regionkey || '}') || '\\x00'::BLOB ORDER BY n_nationkey), lambda a, b: a || b)) AS corpus_hash FROM nation""")
def corpus_digest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select(F.concat(F.lit("f"), F.lpad(_text("n_nationkey"), 2, "0")).alias("id"), F.col("n_name").alias("content"), F.to_json(F.struct(F.col("n_regionkey").alias("r"))).alias("snapshot"))
    return conformance.corpus_hash(rows)


@query(f"""WITH w AS (SELECT 'http://p' || l_partkey % 50 AS url, l_suppkey AS source, l_discount * CASE WHEN l_shipdate::TIMESTAMP >= TIMESTAMP '{_NOW}' THEN 1 ELSE greatest(0.1, pow(0.5, date_diff('second', l_shipdate::TIMESTAMP, TIMESTAMP '{_NOW}') / 86400.0 / 180)) END AS weight FROM lineitem WHERE l_suppkey % 3 <> l_partkey % 50 % 3 AND l_partkey % 50 % 7 <> 0),
e AS (SELECT url, source, max(weight) AS weight FROM w GROUP BY ALL), u AS (SELECT url, count(*) AS sources, sum(weight) AS signal FROM e GROUP BY url HAVING count(*) >= 2)
SELECT url, sources, round(signal, 6) AS signal, row_number() OVER (ORDER BY round(signal, 9) DESC, url) AS place FROM u ORDER BY round(signal, 9) DESC, url LIMIT 20""")
def citation_signals(spark: SparkSession, folder: str) -> DataFrame:
    part, supplier = F.col("l_partkey") % 50, F.col("l_suppkey")
    url = F.concat(F.lit("http://p"), _text(part))
    rows = table(spark, folder, "lineitem").select(url.alias("url"), supplier.alias("source"), (supplier % 3).alias("host"), (part % 3).alias("cited_host"), F.col("l_discount").alias("trust"), F.col("l_shipdate").cast("timestamp").alias("at"), part.alias("p"))
    found = passes.citation_signals(rows, rows.where("p % 7 = 0").select("url"), _at(_NOW))
    return found.select("url", "sources", F.round("signal", 6).alias("signal"), F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id AS id, 1.0 * least(1.0, ln(1 + doc_id % 30) / ln(21)) + CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END + 0.5 * least(1.0, (doc_id % 500) / 365.0) + CASE WHEN quality = 0 THEN 1.0 ELSE 0 END AS l FROM labels),
d AS (SELECT id, CASE WHEN id % 11 = 0 THEN l * 0.1 ELSE l END AS leverage FROM c WHERE NOT (id % 4 = 0)) SELECT id, round(leverage, 6) AS leverage FROM d ORDER BY round(leverage, 9) DESC, id LIMIT 7""")
def curation_session(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    score = passes.leverage((k % 30).cast("double"), F.col("toxic") == 1, (k % 500).cast("double"), F.col("quality") == 0, F.when(k % 11 == 0, "DISTINCT"))
    cards = table(spark, folder, "labels").select(k.alias("id"), score.alias("leverage"), F.when(k % 4 == 0, _at("1998-08-30")).when(k % 4 == 1, _at("1998-08-01")).alias("snoozed_at"))
    return passes.session(cards, _at(_NOW)).select("id", F.round("leverage", 6).alias("leverage"))


@query("""WITH p AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey % 5 = 0), x AS (SELECT p.a, p.b, s.o_orderdate AS da, t.o_orderdate AS db FROM p JOIN orders s ON s.o_orderkey = a JOIN orders t ON t.o_orderkey = b),
o AS (SELECT DISTINCT CASE WHEN da < db THEN a WHEN db < da THEN b END AS id FROM x)
SELECT o_orderkey AS id, round(o_totalprice * CASE WHEN id IS NULL THEN 1 ELSE 0.6 END, 4) AS rank_score FROM orders LEFT JOIN o ON id = o_orderkey""")
def precedence_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").cast("double").alias("score"))
    pairs = rows.where("id % 5 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return passes.with_precedence(rows, pairs).select("id", F.round("rank_score", 4).alias("rank_score"))


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM documents GROUP BY lang")
def calibration_shares(spark: SparkSession, folder: str) -> DataFrame:
    return passes.calibration_shares(table(spark, folder, "documents"), "lang").select("lang", "n", F.round("fraction", 6).alias("fraction"))


_RULES = [("mine", "source_type", "0", 90.0, 0.2), ("mine", "url_pattern", r"^https?://(www\.)?[a-m][^/]*\.(com|org)\b", 30.0, 0.3), ("theirs", "source_type", "1", 365.0, 0.05), ("theirs", "url_pattern", r"[0-9]{2,}$", 45.0, 0.1), ("third", "url_pattern", "example.*(a|b)", 10.0, 0.6), ("third", "url_pattern", "(unclosed", 1.0, 0.0)]
_FOUND = r"""WITH p AS (SELECT page_id, url, CAST(page_id % 3 AS VARCHAR) AS t FROM pages), f AS (SELECT *, regexp_matches(url, '^https?://(www\.)?[a-m][^/]*\.(com|org)\b') AS m, regexp_matches(url, '[0-9]{2,}$') AS h, regexp_matches(url, 'example.*(a|b)') AS x FROM p)"""


@query(f"""{_FOUND} SELECT page_id, least(CASE WHEN m THEN 30.0 WHEN t = '0' THEN 90.0 END, CASE WHEN h THEN 45.0 WHEN t = '1' THEN 365.0 END, CASE WHEN x THEN 10.0 END)::DOUBLE AS half_life,
 least(CASE WHEN m THEN 0.3 WHEN t = '0' THEN 0.2 END, CASE WHEN h THEN 0.1 WHEN t = '1' THEN 0.05 END, CASE WHEN x THEN 0.6 END)::DOUBLE AS floor FROM f""")
def decay_by_lens(spark: SparkSession, folder: str) -> DataFrame:
    """The decay of every page by lenses with rules for source types and for addresses."""
    rules = spark.createDataFrame(_RULES, "lens string, scope string, match string, half_life double, floor double")
    pages = table(spark, folder, "pages").select("page_id", "url", (F.col("page_id") % 3).cast("string").alias("source_type"))
    return passes.decay_rules(rules, "source_type", "url", pages).select("page_id", "half_life", "floor")


@query(f"""{_FOUND} SELECT page_id, least(CASE WHEN m THEN 30.0 WHEN t = '0' THEN 90.0 ELSE 70.0 END, CASE WHEN h THEN 45.0 WHEN t = '1' THEN 365.0 END, CASE WHEN x THEN 10.0 ELSE 60.0 END)::DOUBLE AS half_life FROM f""")
def utility_by_lens(spark: SparkSession, folder: str) -> DataFrame:
    """As decay_by_lens, with defaults of two lenses."""
    rules = spark.createDataFrame([*_RULES, ("mine", "default", None, 70.0, 0.1), ("third", "default", None, 60.0, 0.9)], "lens string, scope string, match string, half_life double, rate double")
    pages = table(spark, folder, "pages").select("page_id", "url", (F.col("page_id") % 3).cast("string").alias("source_type"))
    return passes.utility_rules(rules, "source_type", "url", pages).select("page_id", "half_life")


@query("""WITH a AS (SELECT upper(n_name) AS name, n_nationkey AS k FROM nation UNION ALL SELECT 'nowhere', -1), n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 GROUP BY 1)
SELECT name, CASE WHEN a.k = -1 THEN 'no_match' WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n < (SELECT avg(n) FROM n) THEN 'low' END AS gap FROM a LEFT JOIN n USING (k)""")
def subject_coverage(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("subject_id"), F.col("n_name").alias("name"))
    asked = nations.select(F.upper("name").alias("name")).union(spark.createDataFrame([("nowhere",)], "name string"))
    claims = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal < 0").select(F.col("c_nationkey").alias("subject_id"))
    few = claims.groupBy("subject_id").count().agg(F.coalesce(F.avg("count"), F.lit(0.0))).first()[0]
    return passes.subject_coverage(asked, nations, claims, few)


@query("""WITH r AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, CASE o_orderkey % 4 WHEN 0 THEN 'PREFER_A' WHEN 1 THEN 'PREFER_B' WHEN 2 THEN 'BOTH_VALID' ELSE 'DEFER' END AS res, o_orderkey AS seq FROM orders),
s AS (SELECT a AS id, seq, CASE res WHEN 'PREFER_B' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS t FROM r WHERE res <> 'DEFER' UNION ALL SELECT b, seq, CASE res WHEN 'PREFER_A' THEN 'SUPERSEDED' ELSE 'ACTIVE' END FROM r WHERE res <> 'DEFER'),
l AS (SELECT id, max_by(t, seq) AS t FROM s GROUP BY id) SELECT o_orderkey AS id, coalesce(t, 'INCONSISTENCY') AS status FROM orders LEFT JOIN l ON id = o_orderkey""")
def reviews_resolved(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders")
    said = F.when(k % 4 == 0, "PREFER_A").when(k % 4 == 1, "PREFER_B").when(k % 4 == 2, "BOTH_VALID").otherwise("DEFER")
    reviews = rows.select(k.alias("a"), (k + 1).alias("b"), said.alias("resolution"), k.alias("at"))
    return passes.resolved(reviews, rows.select(k.alias("id"), F.lit("INCONSISTENCY").alias("status"))).select("id", "status")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN DATE '2020-01-02' WHEN 1 THEN DATE '2024-05-01' WHEN 2 THEN DATE '2023-03-09' WHEN 3 THEN DATE '2022-12-24' ELSE DATE '2019-07-07' END AS day FROM documents""")
def deposit_dates(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 5
    text = F.when(k == 1, "\n# 2024-05-01 notes\n\n").when(k == 2, "Title\n\nMarch 9, 2023\nmore\n").when(k == 3, "24 December 2022\n").otherwise("a\nb\nc\nd\ne\n2001-01-01\n")
    when = passes.deposit_date(F.when(k == 0, _at("2020-01-02")), F.concat(text, "text"), _at("2019-07-07"))
    return table(spark, folder, "documents").select("doc_id", when.cast("date").alias("day"))


@query("""SELECT l_suppkey AS session_id, o.id, o.by FROM (SELECT DISTINCT l_suppkey, l_partkey AS id, 'literal' AS by FROM lineitem WHERE l_returnflag = 'R' UNION ALL
SELECT l_suppkey, id, 'judge' FROM (SELECT l_suppkey, id, row_number() OVER (PARTITION BY l_suppkey ORDER BY sim DESC, id) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey AS id, ((l_partkey * 37) % 101) / 100.0 AS sim FROM lineitem WHERE l_returnflag <> 'R')
 ANTI JOIN (SELECT DISTINCT l_suppkey, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R') USING (l_suppkey, id)) WHERE n <= 3) o""")
def uses_mined(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_partkey").alias("id"), "l_returnflag")
    beliefs = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), _text("p_partkey").alias("key"))
    similar = rows.where("l_returnflag <> 'R'").select("session_id", "id", (F.pmod(F.col("id") * 37, F.lit(101)) / 100.0).alias("sim")).distinct()
    return passes.mined_uses(beliefs, rows.where("l_returnflag = 'R'").select("session_id", _text("id").alias("key")), similar, 1000, 3)


@query("""SELECT o_orderkey AS id, place, place IS NOT NULL AS taken FROM (SELECT o_orderkey, CASE WHEN n <= 25 THEN n END AS place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders))""")
def probes_scheduled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderdate")
    return passes.scheduled(rows, "o_orderpriority", [F.col("o_orderdate")], 25).select("id", F.col("place").cast("long").alias("place"), "taken")


_ECE = "(SELECT sum(n * abs(c - a)) / sum(n) FROM (SELECT count(*) AS n, avg({p}) AS c, avg(ok::INT) AS a FROM i, best GROUP BY least(floor({p} * 10), 9)))"
_COOL = "(1 / (1 + pow((1 - raw) / raw, 1 / best.t)))"


@query(f"""WITH l AS (SELECT CASE WHEN (doc_id * 53) % 89 < 9 THEN 1 - x ELSE x END AS raw, ok FROM (SELECT doc_id, quality = 1 AS ok, CASE WHEN quality = 1 THEN 1 - ((doc_id * 37) % 101) / 250.0 ELSE ((doc_id * 37) % 101) / 250.0 END AS x FROM labels)), i AS (SELECT * FROM l WHERE raw > 1e-7 AND raw < 1 - 1e-7),
f AS (SELECT t, sum(-ln(CASE WHEN ok THEN 1 / (1 + pow((1 - raw) / raw, 1 / t)) ELSE 1 - 1 / (1 + pow((1 - raw) / raw, 1 / t)) END)) AS loss FROM i, (SELECT unnest(range(1, 1001)) / 100.0 AS t) GROUP BY t), best AS (SELECT min_by(t, loss) AS t FROM f),
e AS (SELECT {_ECE.format(p='raw')} AS before, {_ECE.format(p=_COOL)} AS after)
SELECT (SELECT count(*) FROM l) AS n, count(*) AS n_fitted, (SELECT count(*) FROM l) - count(*) AS n_saturated, count(DISTINCT raw) AS distinct_raw, round(avg(ok::INT), 6) AS positive_rate,
 (SELECT t <= 0.011 OR t >= 9.999 FROM best) AS hit_bound, (SELECT after >= before FROM e) AS non_improving FROM i""")
def fit_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """What a fit to all labels is worth: confidences that are right nine times in ten."""
    k = F.col("doc_id")
    near = F.pmod(k * 37, F.lit(101)) / 250.0
    x = F.when(F.col("quality") == 1, 1 - near).otherwise(near)
    rows = table(spark, folder, "labels").select(F.when(F.pmod(k * 53, F.lit(89)) < 9, 1 - x).otherwise(x).alias("raw"), (F.col("quality") == 1).alias("correct"))
    temperature = scoring.fit_temperature(rows, "raw", "correct")
    inner = rows.where(~confidence.saturated(F.col("raw")))
    before, after = (scoring.calibration_error(x, c, "correct").first()["error"] for x, c in ((inner, "raw"), (scoring.calibrate(inner, "raw", temperature), "calibrated")))
    found = passes.fit_diagnostics(rows, "raw", "correct", temperature, before, after)
    return found.select("n", "n_fitted", "n_saturated", "distinct_raw", F.round("positive_rate", 6).alias("positive_rate"), "hit_bound", "non_improving")


@query("""SELECT doc_id, CASE WHEN s >= 0.88 THEN 'duplicate' WHEN s >= 0.25 THEN 'linked' WHEN s >= 0.15 THEN 'suppressed' ELSE 'abstained' END AS decision, CASE WHEN quality = 0 AND source <> 'src1' THEN least(s, 0.5) ELSE s END AS trust FROM (SELECT *, ((doc_id * 37) % 101) / 100.0 AS s FROM documents JOIN labels USING (doc_id))""")
def subject_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").withColumn("s", F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0)
    return rows.select("doc_id", passes.subject_decision(F.col("s")).alias("decision"), conformance.capped_trust(F.col("s"), F.col("quality") == 0, F.col("source") == "src1").alias("trust"))


@query("""WITH b AS (SELECT o_orderpriority AS store, o_orderkey AS id, ((o_orderkey * 37) % 101) / 100.0 AS c, o_orderdate FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY c DESC, id) AS n, count(*) OVER (PARTITION BY store) AS total FROM b)
SELECT store, md5('# Memory digest — ' || store || chr(10) || chr(10) || '_' || count(*) || ' of ' || any_value(total) || ' ACTIVE belief(s), ranked by effective confidence._' || chr(10) || chr(10) || string_agg('- **' || format('{:.2f}', c) || '** claim ' || id || CASE WHEN id % 2 = 0 THEN ' _(a, b)_' ELSE '' END || ' · ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN id % 3 = 0 THEN ' · contested (stance)' ELSE '' END, chr(10) ORDER BY n)
 || CASE WHEN count(*) < any_value(total) THEN chr(10) || chr(10) || '_Showing the top ' || count(*) || ' of ' || any_value(total) || ' by effective confidence; ' || (any_value(total) - count(*)) || ' not shown._' ELSE '' END || chr(10)) AS digest FROM n WHERE n <= 12 GROUP BY store""")
def digests(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("store"), k.alias("id"), F.concat(F.lit("claim "), _text(k)).alias("content"), (F.pmod(k * 37, F.lit(101)) / 100.0).alias("confidence"), F.col("o_orderdate").alias("asserted_on"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("subjects"), F.when(k % 3 == 0, F.array(F.lit("stance"))).otherwise(none).alias("bases"),
    )
    return render.digests(rows, 12).select("store", F.md5("digest").alias("digest"))


@query("""SELECT doc_id, md5('> [!' || CASE doc_id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'warning' ELSE 'note' END || '] Lint [DECAY] — ' || CASE doc_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'OTHER' END || chr(10) || '> **Detail:** old ' || doc_id || chr(10) || '> **Reference:** `' || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '—' END || '`' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '> **Action:** review' ELSE '' END) AS finding,
 md5(CASE WHEN doc_id % 4 = 0 THEN '' ELSE '> [!agreement] Positions on this claim (query-time; not factual confidence)' || chr(10) || '> **Endorses:**' || chr(10) || '> - me (conf 0.50, magnitude 0.25) `ab`' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '> **Disputes:**' || chr(10) || '> - you (conf 0.75) `cd`' ELSE '' END || chr(10) || '> _Holders are unverified raw keys — a count of keys, not verified agents._' END) AS callout FROM documents""")
def callouts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    severity = F.when(k % 3 == 0, "ERROR").when(k % 3 == 1, "WARNING").otherwise("OTHER")
    finding = render.finding_callout(F.lit("DECAY"), severity, F.concat(F.lit("old "), _text(k)), F.when(k % 2 == 0, _text(k)), F.when(k % 5 == 0, "review"))
    position = lambda kind, who, level, strength, key: F.struct(F.lit(kind).alias("kind"), F.lit(who).alias("holder"), F.lit(level).alias("confidence"), F.lit(strength).cast("double").alias("magnitude"), F.lit(key).alias("stance_id"))
    me, you = position("ENDORSES", "me", 0.5, 0.25, "ab-1"), position("DISPUTES", "you", 0.75, None, "cd-2")
    positions = F.when(k % 4 == 0, F.slice(F.array(me), 1, 0)).when(k % 2 == 0, F.array(you, me)).otherwise(F.array(me))
    return table(spark, folder, "documents").select("doc_id", F.md5(finding).alias("finding"), F.md5(render.stance_callout(positions)).alias("callout"))


@query("""WITH b AS (SELECT p_partkey, trim(p_name) AS s FROM part), c AS (SELECT s, count(*) AS m FROM b GROUP BY s) SELECT p_partkey, CASE WHEN m = 1 THEN s ELSE s || '-' || left(md5(p_partkey::VARCHAR), 8) END AS slug FROM b JOIN c USING (s)""")
def narrative_slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", F.md5(_text("p_partkey")).alias("id"), "p_name")
    return render.narrative_names(rows, "id", "p_name").select("p_partkey", "slug")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS polarity, 'kept' AS other, CASE WHEN doc_id % 2 = 0 THEN 'extra' ELSE '' END AS unknown FROM documents""")
def legacy_properties(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    old = F.when(k % 3 == 0, F.create_map(F.lit("polarity"), F.lit("old"), F.lit(st.POLARITY), F.lit("new"), F.lit("x:y"), F.lit("kept"))).otherwise(F.create_map(F.lit("polarity"), F.lit("old"), F.lit("x:y"), F.lit("kept")))
    new = interchange.renamed_properties(old)
    contributor = F.when(k % 2 == 0, '{"id": "a", "role": "author", "extra": 1}').otherwise('{"id": "a", "role": "author"}')
    return table(spark, folder, "documents").select("doc_id", new[st.POLARITY].alias("polarity"), new["x:y"].alias("other"), F.array_join(interchange.unknown_keys(contributor), ",").alias("unknown"))


@query("""SELECT n_nationkey, '{"@context":"http://x.org/context","@type":"Subject","formatVersion":"1","sourceSubjectId":"n' || n_nationkey || '","canonicalName":"' || n_name || '","assertedBy":"me","externalRefs":[{"namespace":"x","externalId":"' || n_nationkey || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"confidence":0.5' ELSE '' END || '}]' || CASE WHEN n_nationkey % 3 = 0 THEN ',"aliases":["other"]' ELSE '' END || '}' AS unit FROM nation""")
def subject_units(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    ref = interchange.external_ref(F.lit("x"), _text(k), F.lit(None).cast("string"), F.when(k % 2 == 0, 0.5).otherwise(1.0))
    aliases = F.when(k % 3 == 0, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return table(spark, folder, "nation").select(k, interchange.subject_unit(F.concat(F.lit("n"), _text(k)), F.col("n_name"), F.lit("me"), F.array(ref), none, aliases, none, "http://x.org/context", "1").alias("unit"))


@query("""SELECT n_nationkey AS k, 'http://x.org/id/n' || n_nationkey AS iri, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'n' || n_nationkey END AS label, CASE WHEN n_nationkey % 3 = 0 THEN 'nmo:Mint' ELSE 'nmo:Concept' END AS class,
 CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'n' || n_nationkey END || CASE WHEN n_nationkey % 5 = 0 THEN ' (Nomisma ' || CASE WHEN n_nationkey % 3 = 0 THEN 'Mint' ELSE 'Concept' END || '): a place' ELSE ' is a ' || CASE WHEN n_nationkey % 3 = 0 THEN 'Mint' ELSE 'Concept' END || ' in the Nomisma numismatic ontology.' END AS content, n_nationkey + 0.5 AS lat, 'http://www.wikidata.org/entity/Q1' AS exact_match FROM nation""")
def concept_claims(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    label = F.when(k % 2 == 0, F.concat(F.lit('"skos:prefLabel": [{"@language": "de", "@value": "x"}, {"@language": "en", "@value": "'), "n_name", F.lit('"}], '))).otherwise("")
    definition = F.when(k % 5 == 0, '"skos:definition": {"@language": "en", "@value": "a place"}, ').otherwise("")
    kind = F.when(k % 3 == 0, '["skos:Concept", "nmo:Mint"]').otherwise('"skos:Concept"')
    blob = F.concat(F.lit('{"@context": {"nm": "http://x.org/id/", "geo": "g"}, "@graph": [{"@id": "http://else/1"}, {"@id": "http://x.org/id/n'), _text(k), F.lit('#this", "geo:lat": {"@type": "xsd:decimal", "@value": "'), _text(k), F.lit('.5"}}, {"@id": "nm:n'), _text(k), F.lit('", '), label, definition, F.lit('"skos:exactMatch": [{"@id": "http://a"}, {"@id": "http://www.wikidata.org/entity/Q1"}], "@type": '), kind, F.lit("}]}"))
    found = catalogues.concept_claims(table(spark, folder, "nation").select(blob.alias("blob")), "blob")
    return found.select(F.regexp_extract("iri", r"n(\d+)$", 1).cast("long").alias("k"), "iri", "label", "class", "content", "lat", "exact_match")


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS coin, trim(p_name) || ' (' || (1900 + p_size) || CASE WHEN p_partkey % 2 = 0 THEN '-' || (1901 + p_size) ELSE '' END || ') GDR' AS label, p_type, p_size FROM part WHERE trim(p_name) <> '')
SELECT coin, 'infobox' AS kind, label || ': made of ' || lower(p_type) || ', diameter ' || p_size || '.0mm.' AS content FROM p UNION ALL SELECT coin, 'reference', label || ' is catalogued as KM# ' || coin || '.' FROM p""")
def issuer_claims(spark: SparkSession, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    coin = F.struct(k.alias("id"), "p_name", F.lit(1).alias("x"))
    high = F.when(k % 2 == 0, 1901 + size).otherwise(1900 + size)
    reference = F.array(F.struct(F.struct(F.lit("KM").alias("code")).alias("catalogue"), _text(k).alias("number")), F.struct(F.struct(F.lit("").alias("code")).alias("catalogue"), F.lit("1").alias("number")))
    coin = F.struct(_text(k).alias("id"), F.col("p_name").alias("title"), (1900 + size).alias("min_year"), high.alias("max_year"), F.struct(F.lit("Coin").alias("name")).alias("object_type"), F.struct(F.col("p_type").alias("text")).alias("composition"), size.cast("double").alias("size"), reference.alias("references"))
    blob = F.to_json(F.struct(F.lit("DDR").alias("issuer_code"), F.lit("Germany East").alias("issuer_name"), F.array(coin).alias("types")))
    return catalogues.issuer_claims(table(spark, folder, "part").select(blob.alias("blob")), "blob", {"ddr": "GDR"}).select("coin", "kind", "content")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN round(1 / (1 + exp(-ln(c / (1 - c)) / 2.0)), 6) ELSE c END AS value, CASE WHEN doc_id % 3 = 0 THEN 'CALIBRATED_BENCHMARK' ELSE 'EXTRACTOR_DIRECT' END AS source, CASE WHEN doc_id % 3 = 2 THEN 'PROSE' ELSE 'STRUCTURED' END AS form, CASE WHEN doc_id % 3 <> 2 THEN 's1' END AS subject_id
FROM (SELECT doc_id, ((doc_id * 37) % 99 + 1) / 100.0 AS c FROM documents)""")
def candidates_as_claims(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    claim = F.struct(F.struct(F.lit("TOKEN").alias("kind"), F.lit("alpha").alias("value")).alias("subject"))
    rows = table(spark, folder, "documents").select(
        "doc_id", F.lit("e").alias("entry_id"), F.lit("s").alias("snapshot_id"), F.lit(None).cast("string").alias("chunk_hash"), (F.pmod(k * 37, F.lit(99)) + 1).cast("double").alias("c"), F.array(F.lit("Alpha")).alias("subjects"), F.array(F.lit("s1")).alias("subject_ids"),
        F.when(k % 3 != 2, claim).alias("claim"), F.lit("STRUCTURED").alias("canonical_form"), F.when(k % 3 == 0, "m1").otherwise("m2").alias("model"),
    ).withColumn("confidence", F.col("c") / 100.0)
    fits = spark.createDataFrame([("m1", "logit", 2.0), ("m2", "identity", 3.0)], "model string, transform string, temperature double")
    found = replies.as_claims(rows, fits, "general", "1.0.0")
    return found.select("doc_id", F.when(F.col("confidence.method").isNotNull(), F.round("confidence.value", 6)).otherwise(F.col("confidence.value")).alias("value"), "confidence.source", F.col("canonical_form").alias("form"), "subject_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, 'Order ' || o_orderkey || chr(10) || '"' || o_orderpriority || '" — ü' AS content, CAST(o_custkey % 101 AS DOUBLE) / 100 AS confidence, o_orderdate AS asserted_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 9 DAY END AS valid_until,
 CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 0 END::BIGINT AS sources, CASE WHEN o_orderkey % 3 > 0 THEN 'e' || o_custkey END AS entry, 'c' || o_custkey AS subject, CAST(CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS ref_confidence,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || ',' END AS tags, CAST(o_totalprice AS DOUBLE) AS price, 'URI' AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'xsd:decimal' END AS datatype, 'author' AS role FROM orders""")
def bundle_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as claims, written as a bundle and read again by ranges of its members."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    term = lambda kind, value, datatype=None: F.struct(F.lit(kind).alias("kind"), value.alias("value"), (datatype if datatype is not None else F.lit(None).cast("string")).alias("datatype"), F.lit(None).cast("string").alias("language"))
    no = F.lit(None).cast("string")
    source = lambda kind, entry: F.struct(F.lit(kind).alias("type"), entry.alias("corpus_entry_id"), no.alias("snapshot_id"), F.lit("p. 1").alias("location"), no.alias("chunk_hash"))
    entry = F.concat(F.lit("e"), _text("o_custkey"))
    ref = F.struct(F.lit("shop").alias("namespace"), _text("o_custkey").alias("id"), no.alias("uri"), F.when(F.col("o_custkey") % 2 == 0, 0.5).otherwise(1.0).alias("confidence"))
    triple = F.struct(term("URI", F.concat(F.lit("http://x.org/"), _text(k))).alias("subject"), term("TOKEN", F.lit("costs")).alias("predicate"), term("LITERAL", _text("o_totalprice"), F.when(k % 2 == 0, "xsd:decimal")).alias("object"), F.lit("reader").alias("structurizer_id"), F.lit("1").alias("structurizer_version"), at.alias("generated_at"))
    orders = table(spark, folder, "orders")
    orders = orders.repartition(1 + orders.count() // _UNITS_PER_MEMBER, "o_orderkey")  # a small file has few parts, and coding a unit takes long
    claims = orders.select(
        _text(k).alias("claim_id"), F.concat(F.lit("Order "), _text(k), F.lit('\n"'), F.col("o_orderpriority"), F.lit('" — ü')).alias("content"), ((F.col("o_custkey") % 101).cast("double") / 100).alias("confidence"),
        F.lit("DERIVED").alias("calibration_source"), F.lit("EPISTEMIC").alias("uncertainty_nature"), F.lit("shop").alias("asserted_by"), at.alias("asserted_at"), F.lit("ACTIVE").alias("status"), F.when(k % 4 == 0, at + F.expr("INTERVAL 9 DAYS")).alias("valid_until"),
        F.when(k % 3 > 0, F.array(source("SOURCE", entry), source("AGENT", entry))).alias("provenance"), F.array(F.struct(F.concat(F.lit("c"), _text("o_custkey")).alias("source_subject_id"), F.lit("Customer").alias("canonical_name"), F.array(ref).alias("external_refs"))).alias("subjects"),
        F.when(k % 5 == 0, F.array(F.col("o_orderstatus"), F.lit(""))).alias("tags"), F.create_map(F.lit("price"), F.to_json(F.struct("o_totalprice"))).alias("properties"),
        F.array(F.struct(F.lit("p:1").alias("id"), F.lit("author").alias("role"), at.alias("at"))).alias("contributors"), triple.alias("structured_claim"),
    )
    bundles.register(spark)
    bounded_batches(spark, 2048)
    path = shared_folder(spark)
    claims.write.format("claimbundle").option("path", path).mode("append").save()
    back = spark.read.format("claimbundle").option("path", path).option("mostunits", "none").load()
    return back.select(
        "claim_id", "content", "confidence", "asserted_at", "valid_until", F.size("provenance").cast("long").alias("sources"), F.get("provenance", F.lit(1))["corpus_entry_id"].alias("entry"), F.get("subjects", F.lit(0))["source_subject_id"].alias("subject"),
        F.get(F.get("subjects", F.lit(0))["external_refs"], F.lit(0))["confidence"].alias("ref_confidence"), F.array_join("tags", ",").alias("tags"), F.get_json_object(F.col("properties")["price"], "$.o_totalprice").cast("double").alias("price"),
        F.col("structured_claim.subject.kind").alias("kind"), F.col("structured_claim.object.datatype").alias("datatype"), F.get("contributors", F.lit(0))["role"].alias("role"),
    )
