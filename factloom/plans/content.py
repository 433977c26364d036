"""Queries over texts, pages, threads, vectors and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.functions import url as u
from factloom.operators import documents as d
from factloom.operators import identity, neighbours, packing
from factloom.plans.registry import query, table
from factloom.sources import interchange
from factloom.streaming import events as ev

_COS = "greatest(0.0, least(1.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-10)))"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s) WHERE place <= 10""")
def embedding_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return neighbours.top_by_cosine(queries, rows, 10)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(0.6 * {_COS.format(a='q.embedding', b='e.embedding')} + 0.4 * ((e.vec_id * 37) % 101) / 100.0, 6) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s) WHERE place <= 40""")
def combined_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return neighbours.top_by_cosine(queries, rows, 40, 0.6, 0.4 * F.pmod(F.col("vec_id") * 37, F.lit(101)) / 100.0)


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1, 'i')) AS host, length(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1, 'i')) AS path_length FROM pages")
def url_host_path(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", u.host(F.col("url")).alias("host"), F.length(F.regexp_extract("url", r"(?i)^https?://[^/?#]*([^?#]*)", 1)).cast("long").alias("path_length"))


_TRACKS = ", ".join(f"'{x}'" for x in u.TRACKING)
_PREFIXES = " OR ".join(f"starts_with(lower(split_part(p, '=', 1)), '{x}')" for x in u.TRACKING_PREFIXES)
#: The canonical form of URLs without escapes, wrappers and ports.
_CANON = f"""(lower(regexp_extract({{0}}, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN regexp_replace(regexp_extract({{0}}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({{0}}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({{0}}, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) IN ({_TRACKS}) OR {_PREFIXES})), '&'), ''), ''))"""


@query(f"SELECT page_id, {_CANON.format('url')} AS canonical FROM pages")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", u.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_CANON.format('url')} AS redirect, 'https' || substr({_CANON.format('url')}, instr({_CANON.format('url')}, '://')) AS cached, {_CANON.format('url')} AS guarded FROM pages")
def url_wrapped(spark: SparkSession, folder: str) -> DataFrame:
    """URLs inside a redirect, a cache address and one with credentials and the default port."""
    url = F.col("url")
    scheme, rest = F.substring_index(url, "://", 1), F.substring_index(url, "://", -1)
    redirect = F.concat(F.lit("https://www.google.com/url?sa=t&q="), F.url_encode(url), F.lit("&usg=1"))
    cached = F.concat(F.lit("https://a-b.cdn.ampproject.org/c/s/"), rest)
    host, path = F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1)
    guarded = F.concat(F.upper(scheme), F.lit("://me:secret@"), F.upper(host), F.when(scheme == "http", ":80").otherwise(":443"), path)
    return table(spark, folder, "pages").select("page_id", *[u.canonical(x).alias(n) for n, x in (("redirect", redirect), ("cached", cached), ("guarded", guarded))])


@query("""SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s"''<>)\\]}`]+', 0, 'i')) AS found FROM pages""")
def url_harvest_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(u.URL), F.lit(0))).cast("long").alias("found"))


@query(f"SELECT page_id, {_CANON.format('url')} AS canonical FROM pages UNION ALL SELECT page_id, 'https://example.org/a' FROM pages")
def url_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's URL and another, out of prose that has both twice, and one that is none."""
    text = F.concat(F.lit('See <a href="'), "url", F.lit('">this</a>, (https://example.org/a/?utm_source=x#top). Again: '), "url", F.lit(" HTTPS://Example.org/a! ftp://no.org http://"))
    return table(spark, folder, "pages").select("page_id", F.explode(u.harvested(text)).alias("canonical"))


def _hidden(page: str) -> str:
    for name in d.HIDDEN:
        page = f"regexp_replace({page}, '<{name}\\b.*?</{name}\\s*>', '', 'gis')"
    return page


def _resolved(text: str) -> str:
    """The references that the pages of the tables hold."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{name}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_resolved(f"regexp_replace(regexp_replace(regexp_replace({_hidden('html')}, '<br\\s*/?>', chr(10), 'gi'), '</p\\s*>', chr(10) || chr(10), 'gi'), '<[^>]+>', '', 'g')")}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", d.html_text(F.col("html")).alias("text"))


_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text AS rest, -1 AS k, '' AS chunk FROM documents UNION ALL
SELECT doc_id, substr(rest, cut + gap + 1), k + 1, left(rest, cut) FROM (SELECT doc_id, rest, k, CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN two > 0 THEN two WHEN one > 0 THEN one ELSE 2000 END AS cut, CASE WHEN length(rest) <= 2000 THEN 0 WHEN two > 0 THEN 2 WHEN one > 0 THEN 1 ELSE 0 END AS gap
 FROM (SELECT *, length(regexp_extract(left(rest, 2000), '(?s)^(.*)\n\n', 1)) AS two, length(regexp_extract(left(rest, 2000), '(?s)^(.*)\n', 1)) AS one FROM c WHERE length(rest) > 0)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS ordinal, sha256(trim(chunk, {_ENDS})) AS chunk_hash, length(trim(chunk, {_ENDS})) AS size FROM c WHERE trim(chunk, {_ENDS}) <> ''""")
def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return d.chunked(table(spark, folder, "documents"), 2000).select("doc_id", "ordinal", "chunk_hash", F.length("chunk").cast("long").alias("size"))


@query("""SELECT doc_id, length(regexp_replace(regexp_replace(text || ' [Edit] x' || chr(10) || '  Retrieved from here' || chr(10) || 'end', '\\[\\s*edit\\s*\\]', '', 'gi'), '(?im)^[ \\t]*(?:This page was last (?:edited|modified)|Retrieved from|Last updated)\\b[^\\n]*$', '', 'g')) AS size FROM documents""")
def drift_removed(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("text", F.lit(" [Edit] x\n  Retrieved from here\nend"))
    return table(spark, folder, "documents").select("doc_id", F.length(d.without_drift(text)).cast("long").alias("size"))


@query("""WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), n AS (SELECT doc_id, md5(text) AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL)
SELECT h.doc_id, 0 AS ordinal, coalesce(n, 0) AS n FROM h LEFT JOIN n ON n.doc_id = h.doc_id AND n.h = h.h""")
def chunk_yields(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.md5("text").alias("chunk_hash"))
    claims = chunks.join(table(spark, folder, "labels").where("quality = 1"), "doc_id").select("doc_id", "chunk_hash")
    return d.chunk_yields(chunks, claims)


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+(?:\s|$)'), lambda s: trim(s) <> '')) AS sentences,
 CASE WHEN length(text) > 2000 THEN 'chars' WHEN len(list_filter(regexp_split_to_array(text, '[.!?]+(?:\s|$)'), lambda s: trim(s) <> '')) > 10 THEN 'sentences' END AS violation FROM documents""")
def granularity_gate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.sentence_count(F.col("text")).cast("long").alias("sentences"), t.granularity_violation(F.col("text"), 2000, 10).alias("violation"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_brand, '#', '-')) WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN replace(p_name, ' ', '_') || '.md' WHEN 4 THEN 'ACTIVE' ELSE p_type END AS name FROM part)
SELECT p_partkey, CASE WHEN name = 'ACTIVE' THEN 'self_vocabulary' WHEN length(name) <= 32 AND regexp_matches(name, '[0-9]') AND regexp_matches(name, '^[A-Z0-9]+(?:[ ._/\\-][A-Z0-9]+)+$') THEN 'reference_code'
 WHEN regexp_matches(name, '\\.md$') THEN 'filename' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$') THEN 'snake_case' END AS class FROM n""")
def non_entity_gate(spark: SparkSession, folder: str) -> DataFrame:
    k, snake = F.col("p_partkey") % 6, F.regexp_replace("p_name", " ", "_")
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.regexp_replace("p_brand", "#", "-"))).when(k == 2, snake).when(k == 3, F.concat(snake, F.lit(".md"))).when(k == 4, "ACTIVE").otherwise(F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", t.non_entity_class(name, vocabulary=("ACTIVE",)).alias("class"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, least(length(text), 1000) + 30 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, cost AS used, 0 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN used + cost > 600 THEN cost ELSE used + cost END, CASE WHEN used + cost > 600 THEN pack + 1 ELSE pack END FROM p JOIN o ON o.conv_id = p.conv_id AND o.i = p.i + 1)
SELECT conv_id, turn, pack FROM p""")
def thread_pack(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", (F.least(F.length("text"), F.lit(1000)) + 30).cast("long").alias("cost"))
    packs, _ = packing.packs(rows, "conv_id", "turn", "cost", 600)
    return packs.select("conv_id", "turn", F.col("pack").cast("int").alias("pack"))


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}'))"


@query(f"""WITH c AS (SELECT conv_id, turn, unnest({_TOK}) AS token, len({_TOK}) AS n FROM conversations WHERE role <> 'user'), m AS (SELECT conv_id, turn, unnest({_TOK}) AS token FROM conversations WHERE role = 'user'),
s AS (SELECT c.conv_id, c.turn, m.turn AS comment_turn, count(*) AS shared, max(n) AS n FROM c JOIN m ON c.conv_id = m.conv_id AND c.token = m.token GROUP BY 1, 2, 3)
SELECT conv_id * 10000 + turn AS claim_id, comment_turn, shared FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, comment_turn) AS r FROM s WHERE shared >= 2 AND shared >= n * 0.2) WHERE r = 1""")
def commenter_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Answers find the user's turn that they take most words from."""
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("thread"), "turn", "role", t.content_tokens(F.col("text"), ()).alias("tokens"))
    claims = rows.where("role <> 'user'").select((F.col("thread") * 10000 + F.col("turn")).alias("claim_id"), "thread", "tokens")
    comments = rows.where("role = 'user'").select(F.col("turn").alias("comment_id"), "thread", F.col("turn").alias("ordinal"), "tokens")
    return d.attributed(claims, comments).select("claim_id", F.col("comment_id").alias("comment_turn"), "shared")


_KEY = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH g AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]+\\s*')) AS s FROM benchmark), gk AS (SELECT item_id, {_KEY.replace('text', 's')} AS k FROM g), x AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\\s*')) AS s FROM documents), xk AS (SELECT doc_id, {_KEY.replace('text', 's')} AS k FROM x)
SELECT item_id, count(DISTINCT doc_id) AS docs FROM gk JOIN xk USING (k) WHERE length(k) >= 20 GROUP BY item_id""")
def benchmark_gold_match(spark: SparkSession, folder: str) -> DataFrame:
    def sentences(name: str, key: str) -> DataFrame:
        rows = table(spark, folder, name).select(key, F.explode(F.split("text", r"[.!?]+\s*")).alias("s"))
        return rows.select(key, t.dedup_key(F.col("s")).alias("k")).where(F.length("k") >= 20).distinct()

    return sentences("benchmark", "item_id").join(sentences("documents", "doc_id"), "k").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("SELECT doc_id, length(text) AS content_length, ((doc_id * 37) % 101) / 100.0 AS value, lang AS tag, 'ACTIVE' AS status FROM documents")
def interchange_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    unit = interchange.to_unit(F.col("doc_id"), F.col("text"), F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0, F.lit("EXTRACTOR_DIRECT"), F.lit("ACTIVE"), F.array("lang"), F.lit(None).cast("timestamp"))
    back = docs.select(interchange.from_unit(unit).alias("u"))
    return back.select(F.col("u.sourceClaimId").cast("long").alias("doc_id"), F.length("u.content").cast("long").alias("content_length"), F.col("u.confidence.value").alias("value"), F.element_at("u.tags", 1).alias("tag"), F.col("u.status").alias("status"))


@query("""WITH c AS (SELECT doc_id, md5(text) AS h FROM documents), k AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT 'carried' AS outcome, count(*) AS n FROM c WHERE h IN (SELECT h FROM k) UNION ALL SELECT 'worked', count(*) FROM c WHERE h NOT IN (SELECT h FROM k)""")
def carry_forward_split(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("h"))
    kept, work = identity.carry_forward(chunks, chunks.where("doc_id % 3 = 0"), ["h"])
    return kept.agg(F.lit("carried").alias("outcome"), F.count("*").alias("n")).union(work.agg(F.lit("worked").alias("outcome"), F.count("*").alias("n")))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _naive(ev.windowed(_events(spark, folder), F.window("ts", "1 hour")))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _naive(ev.windowed(_events(spark, folder), F.window("ts", "1 hour", "30 minutes")))


@query("""WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""")
def events_session(spark: SparkSession, folder: str) -> DataFrame:
    return _naive(ev.windowed(_events(spark, folder), F.session_window("ts", "6 hours"), key="user_id"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark: SparkSession, folder: str) -> DataFrame:
    get = lambda name: table(spark, folder, name)
    rows = get("lineitem").join(get("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(get("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(get("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
