"""Queries over claims made of events, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import claims as c
from factloom.functions import confidence as conf
from factloom.functions import text as t
from factloom.operators import identity, scoring, status_logs
from factloom.plans.registry import query, table

NOW = "2024-06-01 00:00:00"
_CONF = "((doc_id * 37) % 101) / 100.0"
_TYPED = "http://www.w3.org/2001/XMLSchema#integer"


def event_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Events as claims: user, type, a typed object and a confidence."""
    e = table(spark, folder, "events")
    datatype = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.lit(_TYPED))
    confidence = F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0
    return e.select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"), datatype.alias("datatype"), confidence.alias("confidence"), F.col("ts").cast("timestamp").alias("ts"))


_EVENT_CLAIMS = """e AS (SELECT event_id, user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'integer' END AS datatype, ((event_id * 37) % 101) / 100.0 AS confidence, ts FROM events)"""
_MATCH = "CASE WHEN datatype IS NULL THEN 'NOT_COMPARABLE' WHEN TRY_CAST(object AS DECIMAL(38,18)) > 40 THEN 'MATCHED' ELSE 'UNMATCHED' END"


@query(f"""WITH {_EVENT_CLAIMS}, m AS (SELECT *, {_MATCH} AS m FROM e)
SELECT predicate, count(*) AS n, round(min(confidence * 0.8), 6) AS low, round(median(confidence * 0.8), 6) AS middle, round(max(confidence * 0.8), 6) AS high
FROM m WHERE m = 'MATCHED' GROUP BY predicate""")
def structural_aggregate_by_predicate(spark: SparkSession, folder: str) -> DataFrame:
    claims = event_claims(spark, folder)
    effective = conf.effective_confidence(F.col("confidence"), F.lit(0.8), F.lit(1.0), F.lit(1.0))
    rows = claims.where(c.match(F.col("predicate"), F.col("object"), F.col("datatype"), c.Filters(above="40")) == "MATCHED").withColumn("ec", effective)
    return scoring.spread_of(rows, "predicate", "ec").select("predicate", "n", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query(f"""WITH {_EVENT_CLAIMS}, m AS (SELECT *, {_MATCH} AS m FROM e)
SELECT count(*) AS active_total, count(object) AS with_claims, count(*) FILTER (m = 'MATCHED') AS matched, count(*) FILTER (m = 'NOT_COMPARABLE') AS not_comparable, count(*) FILTER (m = 'MATCHED' AND confidence < 0.3) AS below_floor FROM m""")
def claim_match_tristate_coverage(spark: SparkSession, folder: str) -> DataFrame:
    claims = event_claims(spark, folder)
    m = claims.withColumn("m", c.match(F.col("predicate"), F.col("object"), F.col("datatype"), c.Filters(above="40")))
    return m.agg(F.count("*").alias("active_total"), F.count("object").alias("with_claims"), F.count_if(F.col("m") == "MATCHED").alias("matched"), F.count_if(F.col("m") == "NOT_COMPARABLE").alias("not_comparable"), F.count_if((F.col("m") == "MATCHED") & (F.col("confidence") < 0.3)).alias("below_floor"))


@query(f"WITH {_EVENT_CLAIMS} SELECT predicate, coalesce(datatype, 'none') AS kind, count(*) AS n FROM e GROUP BY ALL")
def predicate_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    claims = event_claims(spark, folder)
    return claims.groupBy("predicate", F.coalesce(c.xsd_name(F.col("datatype")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENT_CLAIMS}
SELECT predicate, subject % 10 AS bucket, count(*) AS n, round(avg(confidence), 6) AS mean FROM e
WHERE lower(predicate) = 'click' AND contains(object, '5') AND TRY_CAST(object AS DECIMAL(38,18)) < 90 AND datatype IS NOT NULL GROUP BY ALL""")
def claim_filters_combined(spark: SparkSession, folder: str) -> DataFrame:
    claims = event_claims(spark, folder)
    m = c.match(F.col("predicate"), F.col("object"), F.col("datatype"), c.Filters(predicate="CLICK", contains="5", below="90"))
    return claims.where(m == "MATCHED").groupBy("predicate", (F.col("subject") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


_NORM = r"""rtrim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.,;:!?"'']+$', ''))"""


@query(f"SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents")
def content_hash_all(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT sha256({_NORM}) AS content_hash, count(*) AS n, min_by(doc_id, (((doc_id * 37) % 101), doc_id)) AS survivor FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))
    return identity.duplicate_groups(docs, ["content_hash"], [(F.col("doc_id") * 37) % 101, F.col("doc_id")], "doc_id")


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))) AS dedup_key FROM documents")
def content_dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(t.dedup_key(F.col("text"))).alias("dedup_key"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("confidence"))


@query(f"""WITH r AS (SELECT lang, 1 - {_CONF} / row_number() OVER (PARTITION BY lang, source ORDER BY {_CONF} DESC) AS rest FROM documents)
SELECT lang, count(*) AS n, round(1 - product(rest), 6) AS merged FROM r GROUP BY lang""")
def noisy_or_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = scoring.merged_confidence(_documents(spark, folder), ["lang"], "source", "confidence")
    return merged.select("lang", "n", F.round("merged", 6).alias("merged"))


@query("""SELECT o_orderkey, round(CASE WHEN age <= 0 THEN 1 ELSE greatest(0.1, pow(0.5, age / 365.0)) END, 6) AS recency
FROM (SELECT o_orderkey, epoch_us(TIMESTAMP '2000-01-01' - INTERVAL 0 DAY) / 86400e6 - epoch_us(o_orderdate) / 86400e6 AS age FROM orders)""")
def recency_decay(spark: SparkSession, folder: str) -> DataFrame:
    age = conf.age_days(F.col("o_orderdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(conf.recency_of_age(age, F.lit(365.0), F.lit(0.1)), 6).alias("recency"))


@query(f"""SELECT doc_id, round(greatest(0, least(1, {_CONF} * CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.4 ELSE 1 END * CASE WHEN source = 'src0' THEN 1.5 ELSE 1 END)), 6) AS effective
FROM documents LEFT JOIN labels USING (doc_id)""")
def effective_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    extractor = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4)
    trust = F.when(F.col("source") == "src0", 1.5)
    return rows.select("doc_id", F.round(conf.effective_confidence(F.col("confidence"), extractor, trust, F.lit(1.0)), 6).alias("effective"))


_REINFORCED = f"""r AS (SELECT user_id, sum(CASE WHEN value > 50 THEN (value - 50) * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6) / 30.0) ELSE 0 END) AS r FROM events GROUP BY user_id)"""


def _reinforced(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - 50).alias("weight"))
    return scoring.reinforcement(events, ["user_id"], "ts", "weight", 30.0, F.lit(NOW).cast("timestamp"))


@query(f"WITH {_REINFORCED} SELECT user_id, round(r, 6) AS reinforcement FROM r")
def reinforcement_score(spark: SparkSession, folder: str) -> DataFrame:
    return _reinforced(spark, folder).select("user_id", F.round("reinforcement", 6).alias("reinforcement"))


_RANK = f"""{_REINFORCED}, b AS (SELECT doc_id AS id, {_CONF} AS base, ln(1 + coalesce(r, 0)) AS bonus, doc_id % 5 = 0 AS owner,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS dup FROM documents LEFT JOIN r ON r.user_id = doc_id % 50)"""


def _rankable(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).withColumn("user_id", F.col("doc_id") % 50).join(_reinforced(spark, folder), "user_id", "left")
    bonus = F.log1p(F.coalesce("reinforcement", F.lit(0.0)))
    return docs.select(F.col("doc_id").alias("id"), F.col("confidence").alias("base"), bonus.alias("bonus"), (F.col("doc_id") % 5 == 0).alias("owner"), F.md5(t.dedup_key(F.col("text"))).alias("dup"))


@query(f"WITH {_RANK} SELECT id, round(base + 0.015 * bonus, 9) AS score FROM b ORDER BY round(base + 0.015 * bonus, 12) DESC, id LIMIT 40")
def utility_rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.heads(_rankable(spark, folder), "base", "bonus", [0.015], 40).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_RANK} SELECT id, round(base + 0.015 * bonus + CASE WHEN owner THEN 0.04 ELSE 0 END, 9) AS score FROM b ORDER BY round(base + 0.015 * bonus + CASE WHEN owner THEN 0.04 ELSE 0 END, 12) DESC, id LIMIT 40")
def owner_rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rankable(spark, folder).withColumn("base", F.col("base") + 0.015 * F.col("bonus")).withColumn("bonus", F.col("owner").cast("double"))
    return scoring.heads(rows, "base", "bonus", [0.04], 40).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {_RANK}, l AS (SELECT unnest([0.0, 0.01, 0.02, 0.03]) AS lift), p AS (SELECT lift, dup, row_number() OVER (PARTITION BY lift ORDER BY round(base + lift * bonus, 12) DESC, id) AS place FROM b, l),
h AS (SELECT lift, unnest([60, 120, 200]) AS head_size, dup, place FROM p), d AS (SELECT lift, head_size, dup, count(*) AS m FROM h WHERE place <= head_size GROUP BY ALL)
SELECT CAST(lift AS DOUBLE) AS lift, head_size, count(*) AS n_distinct, max(m) AS largest, CAST(ceil(round(sum(m) * 0.95, 9)) AS BIGINT) AS required, count(*) >= ceil(round(sum(m) * 0.95, 9)) AS admissible FROM d GROUP BY lift, head_size""")
def rank_lift_sweep(spark: SparkSession, folder: str) -> DataFrame:
    head = scoring.heads(_rankable(spark, folder), "base", "bonus", scoring.lift_grid(0.03, 3), 200)
    return scoring.head_outcomes(head, [60, 120, 200])


@query(f"""WITH {_RANK}, l AS (SELECT unnest([0.0, 0.02, 0.04, 0.06]) AS lift), p AS (SELECT lift, owner, row_number() OVER (PARTITION BY lift ORDER BY round(base + 0.015 * bonus + CASE WHEN owner THEN lift ELSE 0 END, 12) DESC, id) AS place FROM b, l)
SELECT CAST(lift AS DOUBLE) AS lift, count(*) FILTER (owner) AS owners, round(count(*) FILTER (owner) / 60.0, 6) AS share, count(*) FILTER (owner) >= 10 AND count(*) FILTER (owner) / 60.0 <= 0.5 AS admissible FROM p WHERE place <= 60 GROUP BY lift""")
def owner_lift_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rankable(spark, folder).withColumn("base", F.col("base") + 0.015 * F.col("bonus")).withColumn("bonus", F.col("owner").cast("double"))
    head = scoring.heads(rows, "base", "bonus", scoring.lift_grid(0.06, 3), 60)
    out = head.groupBy("lift").agg(F.count_if("owner").alias("owners"))
    share = F.col("owners") / 60.0
    return out.select("lift", "owners", F.round(share, 6).alias("share"), ((F.col("owners") >= 10) & (share <= 0.5)).alias("admissible"))


_LABELLED = f"l AS (SELECT doc_id, {_CONF} AS raw, quality = 1 AS correct FROM labels)"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("raw"), (F.col("quality") == 1).alias("correct"))


@query(f"WITH {_LABELLED} SELECT doc_id, round(CASE WHEN raw <= 0 THEN 0 WHEN raw >= 1 THEN 1 ELSE 1 / (1 + exp(-ln(raw / (1 - raw)) / 2.5)) END, 6) AS calibrated FROM l")
def calibration_apply(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.calibrate(_labelled(spark, folder), "raw", 2.5).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query(f"""WITH {_LABELLED}, b AS (SELECT least(floor(raw * 10), 9) AS bin, count(*) AS n, avg(raw) AS c, avg(correct::INT) AS a FROM l GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS error FROM b""")
def calibration_ece(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.calibration_error(_labelled(spark, folder), "raw", "correct").select(F.round("error", 6).alias("error"))


@query()
def calibration_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    temperature = scoring.fit_temperature(rows, "raw", "correct")
    fitted = scoring.calibrate(rows, "raw", temperature)
    before, after = scoring.calibration_error(rows, "raw", "correct"), scoring.calibration_error(fitted, "calibrated", "correct")
    return before.select(F.lit(round(temperature, 6)).alias("temperature"), F.round("error", 6).alias("error_before")).crossJoin(after.select(F.round("error", 6).alias("error_after")))  # one row each


@query("SELECT lang, sha256(string_agg(doc_id::VARCHAR, '' ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents GROUP BY lang")
def context_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return identity.fingerprint_by(table(spark, folder, "documents"), ["lang"], "doc_id")


_LADDER = """CASE WHEN s AND NOT al AND con AND nse AND NOT esn THEN 'DOCUMENT_SUPERSEDES' WHEN s AND NOT al AND con AND esn AND NOT nse THEN 'DOCUMENT_SUPERSEDED_BY_EXISTING'
 WHEN NOT (om AND nm) OR NOT con THEN 'CORROBORATES' WHEN s AND NOT al AND abs(gap) >= 0.15 AND gap > 0 THEN 'SUPERSEDES' WHEN s AND NOT al AND abs(gap) >= 0.15 THEN 'SUPERSEDED_BY_EXISTING' ELSE 'INCONSISTENT' END"""


@query(f"""WITH p AS (SELECT doc_id, doc_id % 11 <> 0 AS s, doc_id % 7 = 0 AS al, doc_id % 3 <> 0 AS con, doc_id % 5 = 0 AS nse, doc_id % 10 = 0 AS esn, doc_id % 4 <> 0 AS om, doc_id % 9 <> 0 AS nm,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE ((doc_id * 13) % 101) / 100.0 - ((doc_id * 37) % 101) / 100.0 END AS gap FROM documents) SELECT doc_id, {_LADDER} AS verdict FROM p""")
def conflict_ladder(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    modality = lambda n: F.when(d % n != 0, "FALSIFIABLE").otherwise("EVALUATIVE")
    old = F.when(d % 6 != 0, F.pmod(d * 37, F.lit(101)) / 100.0)
    v = c.verdict(modality(4), modality(9), F.when(d % 7 == 0, "ALEATORY").otherwise("EPISTEMIC"), F.lit("EPISTEMIC"), d % 3 != 0, d % 5 == 0, d % 10 == 0, old, F.pmod(d * 13, F.lit(101)) / 100.0, F.lit(0.15), d % 11 != 0)
    return table(spark, folder, "documents").select("doc_id", v.alias("verdict"))


_STATUSES = ["ACTIVE", "INCONSISTENCY", "PROVENANCE_STALE", "SUPERSEDED", "RETRACTED"]


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN list_extract(['ACTIVE','INCONSISTENCY','PROVENANCE_STALE','SUPERSEDED','RETRACTED'], CAST(o_orderkey % 6 + 1 AS INT)) END AS a,
 list_extract(['ACTIVE','INCONSISTENCY','PROVENANCE_STALE','SUPERSEDED','RETRACTED'], CAST(o_custkey % 5 + 1 AS INT)) AS b FROM orders)
SELECT o_orderkey, coalesce(a, '') || '>' || b IN ('>ACTIVE','>INCONSISTENCY','>PROVENANCE_STALE','ACTIVE>SUPERSEDED','ACTIVE>RETRACTED','ACTIVE>PROVENANCE_STALE','INCONSISTENCY>PROVENANCE_STALE','INCONSISTENCY>RETRACTED','INCONSISTENCY>INCONSISTENCY','PROVENANCE_STALE>SUPERSEDED','PROVENANCE_STALE>RETRACTED','SUPERSEDED>ACTIVE') AS allowed FROM t""")
def status_transition_check(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in _STATUSES])
    old = F.when(F.col("o_orderkey") % 6 < 5, F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")))
    new = F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", c.allowed_transition(old, new).alias("allowed"))


_CHANGES = ["ACTIVE", "SUPERSEDED", "ACTIVE", "PROVENANCE_STALE", "SUPERSEDED", "INCONSISTENCY", "ACTIVE", "SUPERSEDED"]


@query("""WITH l AS (SELECT l_partkey AS claim, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_quantity = 50 AND l_linenumber > 4 THEN 'RETRACTED' ELSE ['ACTIVE', 'SUPERSEDED', 'ACTIVE', 'PROVENANCE_STALE', 'SUPERSEDED', 'INCONSISTENCY', 'ACTIVE', 'SUPERSEDED'][CAST(l_suppkey % 8 + 1 AS INT)] END AS t, l_linenumber % 2 = 0 AS merged FROM lineitem),
s AS (SELECT claim, seq, CASE WHEN t = 'SUPERSEDED' AND merged THEN 'MERGED' ELSE t END AS t FROM l),
f AS (SELECT claim, count(*) AS steps, list_reduce(list_prepend('', list(t ORDER BY seq)), lambda s, t: CASE WHEN replace(s, '!', '') || '>' || t IN
 ('>ACTIVE','>INCONSISTENCY','>PROVENANCE_STALE','ACTIVE>SUPERSEDED','ACTIVE>MERGED','ACTIVE>RETRACTED','ACTIVE>PROVENANCE_STALE','INCONSISTENCY>PROVENANCE_STALE','INCONSISTENCY>RETRACTED','INCONSISTENCY>INCONSISTENCY','PROVENANCE_STALE>SUPERSEDED','PROVENANCE_STALE>MERGED','PROVENANCE_STALE>RETRACTED','MERGED>ACTIVE') THEN t || repeat('!', length(s) - length(replace(s, '!', ''))) ELSE s || '!' END) AS s FROM s GROUP BY claim)
SELECT claim, replace(nullif(replace(s, '!', ''), ''), 'MERGED', 'SUPERSEDED') AS status, steps, length(s) - length(replace(s, '!', '')) AS refused FROM f""")
def status_logs_reduced(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of an order is a step in the log of its part."""
    to = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") > 4), "RETRACTED").otherwise(F.element_at(F.array(*map(F.lit, _CHANGES)), F.nullif((F.col("l_suppkey") % 8 + 1).cast("int"), F.lit(0))))
    why = F.when(F.col("l_linenumber") % 2 == 0, status_logs.REVERSIBLE)
    log = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("claim"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), to.alias("to"), why.alias("why"))
    return status_logs.statuses(log, "claim", "seq", "to", "why", nulls=True).drop("first_refused")


@query("""SELECT o_orderpriority, count(*) FILTER (p = 0 OR p = 1 OR (p = 2 AND o_custkey % 7 >= 3)) AS passing, least(count(*), 500) AS processed, count(*) > 500 AS capped FROM (SELECT *, o_orderkey % 3 AS p FROM orders) GROUP BY 1""")
def cascade_gate_cap(spark: SparkSession, folder: str) -> DataFrame:
    p = F.element_at(F.array(F.lit("OPERATOR_DIRECT"), F.lit("REGISTRY_ENDORSED"), F.lit("REVIEWER_DERIVED")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, folder, "orders").withColumn("passes", c.cascades(p, F.col("o_custkey") % 7, F.lit(3)))
    return rows.groupBy("o_orderpriority").agg(F.count_if("passes").alias("passing"), F.least(F.count("*"), F.lit(500)).cast("long").alias("processed"), (F.count("*") > 500).alias("capped"))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_orderdate AS asserted_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersedes, CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS stored,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 365 DAY END AS valid_until, o_orderstatus FROM orders), s AS (SELECT supersedes AS claim_id, min(asserted_at) AS at FROM c WHERE supersedes IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, count(*) AS visible FROM (SELECT c.*, coalesce(stored, s.at, valid_until) AS retired FROM c LEFT JOIN s USING (claim_id)) WHERE asserted_at <= TIMESTAMP '1998-06-01' AND (retired IS NULL OR retired > TIMESTAMP '1998-06-01') GROUP BY 1""")
def as_of_view(spark: SparkSession, folder: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    claims = table(spark, folder, "orders").select(
        k.alias("claim_id"), at.alias("asserted_at"), F.when(k % 3 == 0, k - 1).alias("supersedes"), F.when(k % 17 == 0, at + F.expr("INTERVAL 30 DAYS")).alias("stored_retired_at"),
        F.when(k % 5 == 0, at + F.expr("INTERVAL 365 DAYS")).alias("valid_until"), "o_orderstatus",
    )
    return identity.visible_at(identity.with_retirement(claims), F.lit("1998-06-01").cast("timestamp")).groupBy("o_orderstatus").agg(F.count("*").alias("visible"))


@query("""WITH l AS (SELECT DISTINCT o_orderkey AS c FROM orders), g AS (SELECT c, c - row_number() OVER (ORDER BY c) AS run FROM l), r AS (SELECT c, min(c) OVER (PARTITION BY run) - 1 AS root FROM g)
SELECT o_orderkey AS claim_id, root, CAST(o_orderkey - root AS BIGINT) AS depth FROM orders JOIN r ON c = o_orderkey""")
def supersession_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Every order supersedes the one before: keys that follow each other are one chain, however long."""
    links = table(spark, folder, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") - 1).alias("supersedes"))
    return identity.supersession_roots(links).drop("cyclic")


@query(f"""WITH r AS (SELECT doc_id, round({_CONF} * w, 9) AS ec FROM documents, (SELECT unnest([1.0, 0.7, 0.5]) AS w)) SELECT doc_id, round(max(ec) - min(ec), 6) AS spread, count(*) AS policies FROM r GROUP BY doc_id""")
def contestedness_spread(spark: SparkSession, folder: str) -> DataFrame:
    rendered = _documents(spark, folder).select("doc_id", F.explode(F.array(*[F.round(F.col("confidence") * w, 9) for w in (1.0, 0.7, 0.5)])).alias("ec"))
    return identity.spread(rendered, "doc_id", "ec").select("doc_id", F.round("spread", 6).alias("spread"), "policies")


@query(f"""SELECT doc_id, nullif(concat_ws(',', CASE WHEN toxic = 1 THEN 'stance' END, CASE WHEN {_CONF} * 0.5 >= 0.2 THEN 'divergence' END, CASE WHEN quality = 0 THEN 'inconsistency' END), '') AS badge FROM documents JOIN labels USING (doc_id)""")
def contested_badge(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    return rows.select("doc_id", identity.badge(F.col("toxic") == 1, F.col("confidence") * 0.5, F.col("quality") == 0).alias("badge"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS s FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS claims FROM b x JOIN b y ON x.c = y.c AND x.s < y.s GROUP BY 1, 2""")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return identity.subject_edges(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT l_partkey AS subject, count(DISTINCT l_orderkey) AS claims, round(max(l_discount), 6) AS most, round(sum(l_quantity), 6) AS utility, bool_or(l_returnflag = 'R') AS contested FROM lineitem GROUP BY 1""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("subject")).agg(F.countDistinct("l_orderkey").alias("claims"), F.round(F.max("l_discount"), 6).alias("most"), F.round(F.sum("l_quantity"), 6).alias("utility"), F.bool_or(F.col("l_returnflag") == "R").alias("contested"))


@query("""WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1) SELECT count(*) AS candidates, least(count(*), 150) AS rendered, greatest(count(*) - 150, 0) AS left_out, sum(k)::BIGINT AS cargo FROM n""")
def graph_census(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("k"))
    return n.agg(F.count("*").alias("candidates"), F.least(F.count("*"), F.lit(150)).cast("long").alias("rendered"), F.greatest(F.count("*") - 150, F.lit(0)).cast("long").alias("left_out"), F.sum("k").alias("cargo"))


@query("""SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = docs.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))
    return out.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH f AS (SELECT 'text' AS field, count(*) FILTER (text <> '') AS populated, count(*) AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang <> ''), count(*) FROM documents UNION ALL SELECT 'quality', count(quality), count(*) FROM documents LEFT JOIN labels USING (doc_id))
SELECT field, populated, round(populated / n, 6) AS rate, populated / n >= 0.8 AS recommended FROM f""")
def field_population(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    filled = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(x, F.lit(False)).alias("has")) for n, x in (("text", F.col("text") != ""), ("lang", F.col("lang") != ""), ("quality", F.col("quality").isNotNull()))])
    out = rows.select(F.explode(filled).alias("x")).groupBy("x.field").agg(F.count_if("x.has").alias("populated"), F.count("*").alias("n"))
    return out.select("field", "populated", F.round(F.col("populated") / F.col("n"), 6).alias("rate"), (F.col("populated") / F.col("n") >= 0.8).alias("recommended"))


@query("""SELECT p_brand, count(*) AS n FROM part WHERE p_type || '/' || p_size = 'SMALL/5' OR p_type = 'SMALL' OR starts_with(p_type || '/', 'ECONOMY/') GROUP BY 1""")
def taxonomy_subtree(spark: SparkSession, folder: str) -> DataFrame:
    tag = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    inside = lambda root: (tag == root) | F.startswith(tag, F.lit(root + "/"))
    return table(spark, folder, "part").where(inside("SMALL") | inside("ECONOMY")).groupBy("p_brand").agg(F.count("*").alias("n"))
