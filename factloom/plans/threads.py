"""Queries that assemble threads into chunks for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as t
from factloom.operators import chunks
from factloom.plans.registry import query, table

_C = "c AS (SELECT conv_id AS thread, turn AS id, CASE WHEN turn > 0 THEN turn // 2 END AS parent, min(role) AS role, coalesce(min(text), '') AS text FROM conversations GROUP BY conv_id, turn)"
_BARE = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _tree(where: str = "true") -> str:
    """Comments below their parents as t, those that ``where`` leaves out with all below them."""
    return f"k0 AS (SELECT * FROM c WHERE {where}), t AS (SELECT k0.*, 0 AS depth, [id] AS path FROM k0 WHERE parent IS NULL UNION ALL SELECT k0.*, t.depth + 1, list_append(t.path, k0.id) FROM k0 JOIN t ON k0.thread = t.thread AND k0.parent = t.id)"


def _sql(bodies: str, body_id: str, header: str, lines: str, name: str, title: str, gap: str, single: int, most: int, last: str = ":", more: int = 0) -> str:
    """The chunks of v(thread, i, line, cost) and b(thread, body), by a recursive fold over each thread."""
    cost = f"(v.cost + {more})"
    return f"""WITH RECURSIVE {_C}, {lines}, b AS ({bodies}),
tot AS (SELECT thread, sum(cost) AS total FROM v GROUP BY thread),
p AS (SELECT thread, i, {cost} AS used, 0 AS pack FROM v WHERE i = 1 UNION ALL SELECT v.thread, v.i, CASE WHEN used + {cost} > {most} THEN {cost} ELSE used + {cost} END, CASE WHEN used + {cost} > {most} THEN pack + 1 ELSE pack END FROM p JOIN v ON v.thread = p.thread AND v.i = p.i + 1),
q AS (SELECT v.thread, v.i, v.line, CASE WHEN total <= {single} THEN 0 ELSE pack END AS pack, total <= {single} AS one FROM v JOIN tot USING (thread) JOIN p ON p.thread = v.thread AND p.i = v.i),
m AS (SELECT *, max(pack) OVER (PARTITION BY thread) + 1 AS total FROM q),
k AS (SELECT m.thread, pack + 1 AS n, CASE WHEN one THEN '{name}' ELSE '{name}_' || (pack + 1) || '_of_' || total END AS chunk_id,
 concat_ws({gap}, any_value({header}), any_value(CASE WHEN one THEN '{title}{last}' ELSE '{title} (chunk ' || (pack + 1) || '/' || total || '){last}' END), string_agg(line, {gap} ORDER BY i)) AS chunk FROM m GROUP BY m.thread, pack, one, total)
SELECT thread, CAST(n AS INT) AS n, chunk_id, sha256(chunk) AS chunk_hash FROM (SELECT thread, 0 AS n, '{body_id}' AS chunk_id, body AS chunk FROM b UNION ALL SELECT * FROM k)"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("thread"), F.col("turn").alias("id")).agg(F.min("role").alias("role"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    return rows.withColumns({"parent": F.when(F.col("id") > 0, F.floor(F.col("id") / 2)), "ordinal": F.col("id")})


@query(_sql(
    "SELECT thread, 'HACKER NEWS THREAD: Talk ' || thread || chr(10) || 'Posted by hn/u' || thread || ' [score: ' || thread % 7 || ']' || CASE WHEN thread % 2 = 0 THEN chr(10) || 'External URL: http://x.org/' || thread ELSE '' END AS body FROM c WHERE id = 0", "story",
    "'# Context: comments on Hacker News thread — Talk ' || m.thread",
    f"{_tree()}, v AS (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY path) AS i, repeat(' ', depth * 2) || 'hn/' || role || ': ' || {_BARE.format('replace(text, chr(10), chr(32))')} AS line, length({_BARE.format('text')}) + depth * 2 + 20 AS cost FROM t WHERE id % 5 <> 4 AND {_BARE.format('text')} <> '')",
    "comments", "COMMENTS", "chr(10)", 900, 700,
))
def thread_news_chunks(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    name = F.col("thread").cast("string")
    stories = turns.where("id = 0").select("thread", F.concat(F.lit("Talk "), name).alias("title"), F.concat(F.lit("u"), name).alias("by"), (F.col("thread") % 7).alias("score"), F.when(F.col("thread") % 2 == 0, F.concat(F.lit("http://x.org/"), name)).alias("url"), F.lit(None).cast("string").alias("text"))
    comments = turns.select("thread", "id", "parent", "ordinal", F.col("role").alias("by"), "text", (F.col("id") % 5 == 4).alias("dead"), F.lit(False).alias("deleted"), F.lit(None).cast("long").alias("score"))
    return chunks.news_chunks(stories, comments, single=900, most=700).select("thread", "n", "chunk_id", "chunk_hash")


@query(_sql(
    "SELECT thread, 'REDDIT THREAD: r/talk — Post ' || thread || chr(10) || 'Posted by u/a' || thread || ' [score: 5]' || chr(10) || chr(10) || 'body ' || thread AS body FROM c WHERE id = 0", "body",
    "'# Context: comments on r/talk thread — Post ' || m.thread",
    f"{_tree('id % 6 <> 5')}, s AS (SELECT *, (thread * 7 + id * 3) % 11 AS score FROM t WHERE text <> ''), v AS (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY score DESC, depth, path) AS i, '[score:' || score || '] u/' || role || ': ' || left(text, 1000) AS line, least(length(text), 1000) + 30 AS cost FROM s WHERE score >= 2)",
    "comments", "TOP COMMENTS", "chr(10)", 700, 450,
))
def thread_forum_chunks(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    name = F.col("thread").cast("string")
    posts = turns.where("id = 0").select("thread", F.lit("talk").alias("forum"), F.concat(F.lit("Post "), name).alias("title"), F.concat(F.lit("a"), name).alias("author"), F.lit(5).alias("score"), F.concat(F.lit("body "), name).alias("text"))
    comments = turns.select("thread", "id", "parent", "ordinal", F.when(F.col("id") % 6 != 5, "t1").otherwise("more").alias("kind"), F.col("role").alias("author"), ((F.col("thread") * 7 + F.col("id") * 3) % 11).alias("score"), F.col("text").alias("body"))
    return chunks.forum_chunks(posts, comments, single=700, most=450).select("thread", "n", "chunk_id", "chunk_hash")


_REPLY = "'mastodon/' || role || id || ': ' || 'Said ' || id || ' & done'"


@query(_sql(
    "SELECT thread, CASE WHEN thread % 4 = 0 THEN 'CONTEXT (ancestors, oldest first):' || chr(10) || 'mastodon/old: before' || chr(10) || chr(10) ELSE '' END || 'MASTODON THREAD on x.social' || CASE WHEN thread % 3 = 0 THEN ' [BOOST]' ELSE '' END || chr(10) || 'Posted by mastodon/me [favourites: ' || thread % 9 || ', boosts: 0, replies: 2]' || CASE WHEN thread % 5 = 0 THEN chr(10) || 'CW: food' ELSE '' END || chr(10) || chr(10) || 'Hello ' || thread || chr(10) || 'there' AS body FROM c WHERE id = 0", "status",
    "'# Context: replies on Mastodon thread — ' || CASE WHEN m.thread % 5 = 0 THEN 'food' ELSE 'Hello ' || m.thread || chr(10) || 'there' END",
    f"{_tree('id % 5 <> 3')}, v AS (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY path) AS i, repeat(' ', depth * 2) || {_REPLY} AS line, length(repeat(' ', depth * 2) || {_REPLY}) AS cost FROM t)",
    "replies", "REPLIES", "chr(10)", 120, 80, more=1,
))
def thread_status_chunks(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    none = F.lit(None).cast("string")
    own = F.struct(F.concat(F.lit("<p>Hello "), F.col("thread").cast("string"), F.lit("<br/>there</p>")).alias("content"))
    ancestor = F.struct(F.lit("old").alias("account"), F.lit("<p>before</p>").alias("content"), F.lit(None).cast("struct<content:string>").alias("boosted"), none.alias("warning"))
    statuses = turns.where("id = 0").select(
        "thread", F.lit("x.social").alias("instance"), F.lit("me").alias("account"), F.when(F.col("thread") % 3 != 0, own["content"]).otherwise("").alias("content"), F.when(F.col("thread") % 3 == 0, own).alias("boosted"), F.when(F.col("thread") % 5 == 0, " food ").alias("warning"),
        (F.col("thread") % 9).alias("favourites"), F.lit(None).cast("long").alias("boosts"), F.lit(2).alias("replies"), F.when(F.col("thread") % 4 == 0, F.array(ancestor)).otherwise(F.array().cast("array<struct<account:string,content:string,boosted:struct<content:string>,warning:string>>")).alias("above"),
    )
    said = F.concat(F.lit("<p>Said "), F.col("id").cast("string"), F.lit(" &amp; done</p>"))
    replies = turns.select("thread", "id", "parent", "ordinal", F.concat("role", F.col("id").cast("string")).alias("account"), said.alias("content"), F.lit(None).cast("struct<content:string>").alias("boosted"), none.alias("warning"), F.when(F.col("id") % 5 == 3, 0).otherwise(4).alias("favourites"))
    return chunks.status_chunks(statuses, replies, least_favourites=1, single=120, most=80).select("thread", "n", "chunk_id", "chunk_hash")


@query(_sql(
    "SELECT thread, 'Gist description: Notes ' || thread || chr(10) || chr(10) || 'Gist by gh/me' || chr(10) || chr(10) || '## a.py' || chr(10) || chr(10) || 'x = ' || thread AS body FROM c WHERE id = 0", "body",
    "'# Context: comments on a gist by gh/me, titled \"Notes ' || m.thread || '\".'",
    "v AS (SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY id) AS i, 'gh/' || role || ': ' || left(text, 1000) AS line, least(length(text), 1000) + 30 AS cost FROM c QUALIFY row_number() OVER (PARTITION BY thread ORDER BY id) <= 50)",
    "comments", "## Comments", "chr(10) || chr(10)", 600, 400, last="",
))
def thread_gist_chunks(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    name = F.col("thread").cast("string")
    files = F.array(F.struct(F.lit("a.py").alias("name"), F.concat(F.lit("x = "), name).alias("content")))
    gists = turns.where("id = 0").select("thread", F.concat(F.lit("Notes "), name).alias("description"), F.lit("me").alias("owner"), files.alias("files"))
    comments = turns.select("thread", "ordinal", F.col("role").alias("login"), F.col("text").alias("body"))
    return chunks.gist_chunks(gists, comments, single=600, most=400).select("thread", "n", "chunk_id", "chunk_hash")


@query("""WITH c AS (SELECT conv_id AS thread, turn, min(role) || turn % 3 AS login, coalesce(min(text), '') AS text FROM conversations GROUP BY conv_id, turn),
n AS (SELECT *, len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}'))) AS k FROM c), f AS (SELECT thread, login, min_by(text, turn) AS text FROM n WHERE k >= 5 GROUP BY ALL)
SELECT thread, login, length('@' || login || ' commented on this gist: "' || CASE WHEN length(trim(text)) <= 300 THEN trim(text) ELSE left(trim(text), 297) || '...' END || '"') AS size FROM f WHERE login <> 'user0'""")
def thread_missing_commenters(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder).withColumn("login", F.concat("role", (F.col("id") % 3).cast("string")))
    comments = turns.select("thread", "ordinal", "login", F.col("text").alias("body"), t.content_tokens(F.col("text"), ()).alias("tokens"))
    claims = turns.where("id = 0").select("thread", F.array(F.lit("github:user0"), F.lit("other")).alias("subjects"))
    return chunks.missing_commenters(claims, comments).select("thread", "login", F.length("content").cast("long").alias("size"))


@query("""SELECT conv_id AS thread, 'Hacker News thread ''Talk ' || conv_id || ''' by hn/u' || conv_id || ' received ' || conv_id % 7 || ' points and ' || count(DISTINCT turn) || ' comments.' AS content, conv_id % 7 AS points, count(DISTINCT turn) AS comments FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id""")
def thread_story_claims(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("thread").cast("string")
    stories = _turns(spark, folder).groupBy("thread").agg(F.count("*").alias("descendants")).select("thread", F.col("thread").alias("id"), F.concat(F.lit("Talk "), name).alias("title"), F.when(F.col("thread") % 9 != 0, F.concat(F.lit("u"), name)).alias("by"), (F.col("thread") % 7).alias("score"), F.lit(None).cast("string").alias("url"), "descendants")
    found = chunks.story_claims(stories)
    value = lambda k: F.get_json_object("properties", f"$['{k}']").cast("long")
    return found.select("thread", "content", value("hn:hasPoints").alias("points"), value("social:hasReplyCount").alias("comments"))
