"""One query for each operator, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, language, licenses, line_quality, ngram_join, passages, pii, resampling, samples, secrets, sentencepiece_lattice, sharding, token_alignment, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    found = language.languages(docs, language.fit(docs))
    return found.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "reliable")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles overlap in 75 per cent."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS s
       FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and detections in every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.greatest(best, F.lit(0.95))).otherwise(best).alias("score"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    rows = winnowing.beside_next(_table(spark, sf_dir, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.withColumn("edited", edited).withColumn("edited_marks", winnowing.fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest(F.col("marks")).alias("fingerprint"), winnowing.digest(F.col("edited_marks")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("hashes"), winnowing.hashes_of(F.col("edited_marks"))).alias("near_edited"),
        winnowing.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    rows = sharding.shards(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes, by the table t.tab."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT)"


OP5_SQL = f"""
WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32, CAST({_crc32("doc_id::VARCHAR")} AS BIGINT) AS spread FROM documents, t),
p AS (SELECT *, 2 * sum(size) OVER w - size AS middle, row_number() OVER w - 1 AS rank, sum(size) OVER () AS total FROM d WINDOW w AS (ORDER BY text_crc32 * 2147483648 + spread % 2147483648, doc_id, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least(23, floor(middle * 24 / (2.0 * total))) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
        FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
        FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
occ AS (SELECT doc_id, pos.k, i, item FROM pos JOIN win ON pos.k = win.k AND pos.win = win.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier elsewhere."""
    found = passages.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
pos AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM pos) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and its text from them again."""
    found = sentencepiece_lattice.encode(_table(spark, sf_dir, "documents"))
    text = sentencepiece_lattice.decode(F.col("ids"), sentencepiece_lattice.vocabulary())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    only = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(_span_text(only), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    found = line_quality.quality(docs, line_quality.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: known shapes and strings of high entropy."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    only = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(_span_text(only), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"), F.size("suppressed").cast("long").alias("n_suppressed"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two tokenizers."""
    found = token_alignment.token_links(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (SELECT true AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
d AS (SELECT corpus, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM texts),
word AS (SELECT corpus, id, unnest(w) AS x FROM d),
hashed AS (SELECT x, CAST({_crc32("x")} AS BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT x FROM word), t),
held AS (SELECT corpus, id, bucket, count(*) AS n FROM word JOIN hashed USING (x) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (corpus) AS s, sum(n) FILTER (NOT corpus) AS t FROM held GROUP BY bucket),
every AS (SELECT b AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM every) + 10000) / ((s + 1) * ((SELECT sum(t) FROM every) + 10000)))) AS BIGINT) AS gain FROM every),
sums AS (SELECT id AS doc_id, CAST(sum(n * gain) AS DOUBLE) AS total, sum(n) AS n FROM held JOIN gain USING (bucket) WHERE corpus GROUP BY id),
scored AS (SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST(concat('0x', left(sha256('2024:' || d.id), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN sums ON d.id = sums.doc_id WHERE corpus),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS every FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * every // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


#: For each kind: pattern, condition on match m, start of the span before end e.
_OP9_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "length(m)", 0.9, "", ""),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT))) <= 255", "length(m)", 0.6, "", ""),
    "card": (r"[0-9]([\x20-]?[0-9])+", """length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND
        list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)
        ELSE (CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) * 2 - CASE WHEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) > 4 THEN 9 ELSE 0 END) END)) % 10 = 0""", "length(m)", 0.8, "", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15", "length(m)", 0.6, "", ""),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''), lambda c: (ascii(c) - CASE WHEN ascii(c) < 58 THEN 48 ELSE 55 END)::HUGEINT)),
        lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1""", "length(m)", 0.8, "", ""),
    "secret": ("(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)[\"'']?[ \\t]*[=:][ \\t]*[\"'']?[A-Za-z0-9+/_=-]{16,}", "regexp_matches(m, '[0-9]')", "length(regexp_extract(m, '[A-Za-z0-9+/_=-]{16,}$'))", 0.6, "key|auth|login|bearer|config|env", "example|dummy|sample"),
}


def _op9_sql() -> str:
    kinds = []
    for i, (kind, (pattern, holds, size, score, raises, lowers)) in enumerate(_OP9_KINDS.items()):
        near = "lower(right(p[i], 40) || ' ' || left(p[i + 1], 40))"
        scored = f"AND {score} + CASE WHEN regexp_matches({near}, '{raises}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches({near}, '{lowers}') THEN 0.2 ELSE 0 END >= 0.5" if lowers else ""
        kinds.append(f"""
SELECT doc_id, {i} AS k, '{kind}' AS kind, e - {size} AS s, e FROM (
  SELECT doc_id, p, i, f[i] AS m, coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[:i], lambda x: length(x))), 0) AS e
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS p FROM d), LATERAL (SELECT unnest(range(1, len(f) + 1)) AS i))
WHERE {holds} {scored}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(kinds)}),
agg AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) FILTER (k < 4) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""


def _op11_sql() -> str:
    """Base patterns as in the other span query; windows by counts of their characters."""
    def located(pattern: str) -> str:
        return f"""SELECT doc_id, t, f[i] AS m, coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS p FROM d), LATERAL (SELECT unnest(range(1, len(f) + 1)) AS i)"""

    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password,passwd,secret,token,api_?key").replace(",", "|")
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    value = "[A-Za-z0-9+/_.=-]+"
    assign = f"""({either})["'']?\\x20*[:=]\\x20*["'']?"""
    base = {"assign": (assign + value, f"length(regexp_replace(m, '^{assign}', '')) >= {secrets.LEAST_VALUE}"), "access": ("AKIA[A-Z0-9]+", f"length(m) >= {secrets.LEAST_ACCESS}"), "hex": ("[0-9a-f]+", f"length(m) >= {secrets.LEAST_HEX}")}
    spans = [f"SELECT doc_id, {i} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM ({located(pattern)}) WHERE {holds}" for i, (kind, (pattern, holds)) in enumerate(base.items())]
    more = []
    for i, c in enumerate(secrets.CLASSES):
        run = c.characters.replace("0123456789", "0-9").replace("abcdefghijklmnopqrstuvwxyz", "a-z").replace("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A-Z")
        window, codes = c.window, [0, *(secrets._CODES[k] for k in range(1, c.window + 1))]
        more.append(f"""
c{i} AS (SELECT doc_id, t, m, s FROM ({located(f"[{run}]{{{window},}}")})),
w{i} AS (SELECT doc_id, t, m, s, j, m[j : j + {window - 1}] AS x FROM c{i}, LATERAL (SELECT unnest(range(1, length(m) - {window} + 2)) AS j)),
h{i} AS (SELECT doc_id, t, m, s, j FROM w{i} WHERE length(regexp_replace(x, '[^0-9]', '', 'g')) >= {secrets.LEAST_MIXED} AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= {secrets.LEAST_MIXED}
  AND list_sum(list_transform(map_values(list_histogram(string_split(x, ''))), lambda n: [{', '.join(map(str, codes))}][CAST(n AS BIGINT) + 1])) <= {c.most}),
g{i} AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, s ORDER BY j) AS part FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id, s ORDER BY j) <= {window} THEN 0 ELSE 1 END AS cut FROM h{i})),
e{i} AS (SELECT doc_id, {len(base) + i} AS k, '{c.name}' AS kind, s + min(j) - 1 AS s, s + max(j) - 1 + {window} AS e,
  length(any_value(m)) <= {secrets.SHORT} AND regexp_matches({low.format('any_value(m)')}, '{'|'.join(secrets.PLACEHOLDERS)}') OR regexp_matches({low.format(f"right(left(any_value(t), CAST(s AS BIGINT)), {secrets.NEAR})")}, '{'|'.join(secrets.DIGESTS)}')
  OR regexp_matches(right(left(any_value(t), CAST(s AS BIGINT)), {secrets.IN_ADDRESS}), '://[^\\x20\\x09-\\x0D]*$') AS allowed FROM g{i} GROUP BY doc_id, s, part)""")
    kinds = " UNION ALL ".join(f"SELECT * FROM e{i}" + "".join(f" WHERE NOT EXISTS (FROM e{b} y WHERE y.doc_id = e{i}.doc_id AND y.s < e{i}.e AND e{i}.s < y.e)" for b in range(i)) for i in range(len(secrets.CLASSES)))
    names = list(base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {','.join(more).strip()},
high AS ({kinds}), spans AS ({' UNION ALL '.join(spans)} UNION ALL SELECT doc_id, k, kind, s, e FROM high WHERE NOT allowed),
held AS (SELECT doc_id, count(*) AS n FROM high WHERE allowed GROUP BY doc_id),
agg AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in names)},
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < {len(names)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in names)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_suppressed
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN held USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_ngram_join": op2_ngram_join, "op3_license_scan": op3_license_scan, "op4_fingerprints": op4_fingerprints, "op5_sharding": op5_sharding, "op6_decontamination": op6_decontamination, "op7_repeated_passages": op7_repeated_passages, "op8_sentencepiece": op8_sentencepiece, "op9_pii": op9_pii, "op10_quality": op10_quality, "op11_secret_scan": op11_secret_scan, "op12_token_alignment": op12_token_alignment, "op13_importance_resampling": op13_importance_resampling}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op5_sharding": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_repeated_passages": OP7_SQL, "op9_pii": _op9_sql(), "op11_secret_scan": _op11_sql(), "op13_importance_resampling": OP13_SQL}
