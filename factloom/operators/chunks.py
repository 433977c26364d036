"""Threads as chunks of text for a model: the body first, then comments packed to size.

Comments are packed in blocks of rows (packing.packs), so a thread of any length
is spread over tasks; what comes together is a chunk's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.functions.text import stripped
from factloom.operators import packing
from factloom.operators.documents import plain_text
from factloom.operators.threads import tree_paths

#: Sizes of chunks in characters, and what a thread is fetched with.
SINGLE, CHUNK, BODY_LIMIT, INDENT, MOST_COMMENTS = 30_000, 10_000, 1000, 2, 200


def comment_chunks(lines: DataFrame, headers: DataFrame, name: str = "comments", title: str = "COMMENTS", gap: str = "\n", single: int = SINGLE, most: int = CHUNK, last: str = ":", more: int = 0) -> DataFrame:
    """thread, n, chunk_id, chunk of lines(thread, place, line, cost) below headers(thread, header).

    One chunk if the costs of a thread reach at most ``single``, else greedy
    packs of at most ``most``, numbered; packs count ``more`` for each line.
    Lines that are null cost, but aren't shown.
    """
    totals = lines.groupBy("thread").agg((F.sum("cost") <= single).alias("one"))
    rows, sizes = packing.packs(lines.withColumn("cost", F.col("cost") + more), "thread", "place", "cost", most)
    rows = rows.join(totals, "thread").join(sizes.select("thread", "packs"), "thread")
    rows = rows.select("thread", "place", "line", "one", F.when(F.col("one"), 1).otherwise(F.col("pack") + 1).cast("int").alias("n"), F.when(F.col("one"), 1).otherwise(F.col("packs")).cast("int").alias("of"))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "line")))), lambda r: r["line"])
    packed = rows.groupBy("thread", "one", "n", "of").agg(shown.alias("lines")).join(headers, "thread", "left")
    heading = F.when(F.col("one"), F.lit(f"{title}{last}")).otherwise(F.concat(F.lit(f"{title} (chunk "), F.concat_ws("/", "n", "of"), F.lit(f"){last}")))
    chunk_id = F.when(F.col("one"), name).otherwise(F.concat(F.lit(f"{name}_"), "n", F.lit("_of_"), "of"))
    return packed.select("thread", "n", chunk_id.alias("chunk_id"), F.concat_ws(gap, F.col("header"), heading, F.col("lines")).alias("chunk"))


#: Parts that a thread's comments are dealt over before its first ones are sought.
PARTS = 64


def first_rows(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """rows with place (from 0): the first ``top`` of each thread, sought in parts of it first."""
    part = Window.partitionBy("thread", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "thread"]), F.lit(PARTS)))
    some = rows.withColumn("place", F.row_number().over(part.orderBy(*order))).where(F.col("place") <= top)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("thread").orderBy(*order)) - 1).where(F.col("place") < top)


def _with_bodies(bodies: DataFrame, name: str, chunks: DataFrame) -> DataFrame:
    body = bodies.where("trim(body) <> ''").select("thread", F.lit(0).alias("n"), F.lit(name).alias("chunk_id"), F.col("body").alias("chunk"))
    return body.unionByName(chunks).withColumn("chunk_hash", F.sha2("chunk", 256))


def _said(text: Column) -> Column:
    return stripped(F.regexp_replace(text, "\n", " "))


def news_chunks(stories: DataFrame, comments: DataFrame, indent: int = INDENT, least_score: int = 1, single: int = SINGLE, most: int = CHUNK) -> DataFrame:
    """Chunks of news stories: thread, n, chunk_id, chunk, chunk_hash.

    stories(thread, title, by, score, url, text), comments(thread, id, parent,
    ordinal, by, text, dead, deleted, score). Comments come depth first; one
    without text, dead, deleted or scored too low is hidden, what is below it isn't.
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("HACKER NEWS THREAD: "), some(F.col("title")), F.lit("\nPosted by hn/"), some(F.col("by")), F.lit(" [score: "), F.coalesce("score", F.lit(0)).cast("string"), F.lit("]"))
    url = F.when(some(F.col("url")) != "", F.concat(F.lit("\nExternal URL: "), "url")).otherwise("")
    text = stripped(some(F.col("text")))
    bodies = stories.select("thread", F.concat(head, url, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise("")).alias("body"))
    headers = stories.select("thread", F.concat(F.lit("# Context: comments on Hacker News thread — "), F.left(some(F.col("title")), F.lit(120))).alias("header"))
    tree = tree_paths(comments)
    shown = (stripped(some(F.col("text"))) != "") & ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & F.coalesce(F.col("score") >= least_score, F.lit(True))
    line = F.concat(F.repeat(F.lit(" "), F.col("depth") * indent), F.lit("hn/"), F.when(some(F.col("by")) == "", "anon").otherwise(F.col("by")), F.lit(": "), _said(F.col("text")))
    lines = tree.where(shown).select("thread", F.col("path").alias("place"), line.alias("line"), (F.length(stripped(F.col("text"))) + F.col("depth") * indent + 20).alias("cost"))
    return _with_bodies(bodies, "story", comment_chunks(lines, headers, single=single, most=most))


def forum_chunks(posts: DataFrame, comments: DataFrame, least_score: int = 2, top: int = MOST_COMMENTS, limit: int = BODY_LIMIT, single: int = SINGLE, most: int = CHUNK) -> DataFrame:
    """Chunks of forum posts: thread, n, chunk_id, chunk, chunk_hash.

    posts(thread, forum, title, author, score, text), comments(thread, id,
    parent, ordinal, kind, author, score, body). Comments of kind t1 with a body
    that isn't removed and with at least the score, the best first, equal ones
    breadth first; the first ``top``. What replies to a hidden comment can be
    shown; what replies to another kind isn't read.
    """
    forum = F.coalesce("forum", F.lit("unknown"))
    text = stripped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("REDDIT THREAD: r/"), forum, F.lit(" — "), F.coalesce("title", F.lit("")), F.lit("\nPosted by u/"), F.coalesce("author", F.lit("")), F.lit(" [score: "), F.coalesce("score", F.lit(0)).cast("string"), F.lit("]"))
    bodies = posts.select("thread", F.concat(head, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise("")).alias("body"))
    headers = posts.select("thread", F.concat(F.lit("# Context: comments on r/"), forum, F.lit(" thread — "), F.left(F.coalesce("title", F.lit("")), F.lit(120))).alias("header"))
    tree = tree_paths(comments, prune=F.col("kind") == "t1")
    score = F.coalesce("score", F.lit(0))
    kept = tree.where((F.coalesce("body", F.lit("")) != "") & ~F.col("body").isin("[deleted]", "[removed]") & (score >= least_score))
    line = F.concat(F.lit("[score:"), score.cast("string"), F.lit("] u/"), F.coalesce("author", F.lit("")), F.lit(": "), F.left("body", F.lit(limit)))
    each = kept.select("thread", (-score).alias("order"), "depth", "path", line.alias("line"), (F.least(F.length("body"), F.lit(limit)) + 30).alias("cost"))
    lines = first_rows(each, [F.asc("order"), F.asc("depth"), F.asc("path")], top).select("thread", "place", "line", "cost")
    return _with_bodies(bodies, "body", comment_chunks(lines, headers, title="TOP COMMENTS", single=single, most=most))


def count_or_zero(value: Column) -> Column:
    """A count, or 0 where there is none."""
    return F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))


def status_text(status: Column) -> Column:
    """The readable text of a status(content, boosted struct(content)): that of what it boosts, if it boosts."""
    return F.coalesce(plain_text(F.when(status["boosted"].isNotNull(), status["boosted"]["content"]).otherwise(status["content"])), F.lit(""))


def status_chunks(statuses: DataFrame, replies: DataFrame, indent: int = INDENT, least_favourites: int = 0, single: int = SINGLE, most: int = CHUNK) -> DataFrame:
    """Chunks of status threads: thread, n, chunk_id, chunk, chunk_hash.

    statuses(thread, instance, account, content, boosted struct(content),
    warning, favourites, boosts, replies, above array of struct(account,
    content, boosted, warning), the oldest first); replies(thread, id, parent
    (null: answers the status itself), ordinal, account, content, boosted,
    warning, favourites), depth first. A reply with too few favourites goes with
    all below it.
    """
    warning = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def said(s: Column, depth: Column) -> Column:
        body = let(_said(status_text(s)), lambda b: let(warning(s["warning"]), lambda w: F.when(w != "", F.concat(F.lit("[CW: "), w, F.lit("] "), b)).otherwise(b)))
        account = F.when(F.coalesce(s["account"], F.lit("")) == "", "anon").otherwise(s["account"])
        return F.concat(F.repeat(F.lit(" "), depth * indent), F.lit("mastodon/"), account, F.lit(": "), body)

    s = statuses.withColumn("text", status_text(F.struct("content", "boosted"))).withColumn("cw", warning(F.col("warning")))
    boost = F.when(F.col("boosted").isNotNull(), " [BOOST]").otherwise("")
    instance = F.when(F.coalesce("instance", F.lit("")) == "", "mastodon").otherwise(F.col("instance"))
    counts = F.format_string("[favourites: %d, boosts: %d, replies: %d]", count_or_zero(F.col("favourites")), count_or_zero(F.col("boosts")), count_or_zero(F.col("replies")))
    headline = F.concat(F.lit("MASTODON THREAD on "), instance, boost, F.lit("\nPosted by mastodon/"), F.coalesce("account", F.lit("")), F.lit(" "), counts)
    headline = F.concat(headline, F.when(F.col("cw") != "", F.concat(F.lit("\nCW: "), "cw")).otherwise(""), F.when(F.col("text") != "", F.concat(F.lit("\n\n"), "text")).otherwise(""))
    above = F.when(F.size("above") > 0, F.concat(F.lit("CONTEXT (ancestors, oldest first):\n"), F.array_join(F.transform("above", lambda a: said(a, F.lit(0))), "\n"), F.lit("\n\n"))).otherwise("")
    bodies = s.select("thread", F.trim(F.concat(above, headline)).alias("body"))
    subject = F.coalesce(F.when(F.col("cw") != "", F.left("cw", F.lit(120))), F.when(F.col("text") != "", F.left("text", F.lit(80))), F.lit("(no subject)"))
    headers = s.select("thread", F.concat(F.lit("# Context: replies on Mastodon thread — "), subject).alias("header"))
    prune = count_or_zero(F.col("favourites")) >= least_favourites if least_favourites > 0 else None
    tree = tree_paths(replies, prune=prune)
    lines = tree.select("thread", F.col("path").alias("place"), said(F.struct("account", "content", "boosted", "warning"), F.col("depth")).alias("line"))
    lines = lines.withColumn("cost", F.length("line"))
    # one more for the line's end, which only the packs count
    return _with_bodies(bodies, "status", comment_chunks(lines, headers, "replies", "REPLIES", single=single, most=most, more=1))


def gist_chunks(gists: DataFrame, comments: DataFrame, top: int = 50, limit: int = BODY_LIMIT, single: int = SINGLE, most: int = CHUNK) -> DataFrame:
    """Chunks of gists: thread, n, chunk_id, chunk, chunk_hash.

    gists(thread, description, owner, files array of struct(name, content)),
    comments(thread, ordinal, login, body), of which the first ``top`` count;
    one without login or body costs, but isn't shown.
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    parts = F.array(F.when(some(F.col("description")) != "", F.concat(F.lit("Gist description: "), "description")), F.when(some(F.col("owner")) != "", F.concat(F.lit("Gist by gh/"), "owner")))
    files = F.transform("files", lambda f: F.concat(F.lit("## "), f["name"], F.lit("\n\n"), some(f["content"])))
    bodies = gists.select("thread", F.trim(F.concat_ws("\n\n", parts, files)).alias("body"))
    by = F.when(some(F.col("owner")) != "", F.concat(F.lit("Context: comments on a gist by gh/"), "owner"))
    titled = F.when(some(F.col("description")) != "", F.concat(F.lit('titled "'), F.left("description", F.lit(120)), F.lit('"')))
    header = let(F.concat_ws(", ", by, titled), lambda h: F.when(h == "", "# Gist comments").otherwise(F.concat(F.lit("# "), h, F.lit("."))))
    headers = gists.select("thread", header.alias("header"))
    line = F.when((some(F.col("login")) != "") & (F.trim(some(F.col("body"))) != ""), F.concat(F.lit("gh/"), "login", F.lit(": "), F.left("body", F.lit(limit))))
    each = comments.select("thread", "ordinal", line.alias("line"), (F.least(F.length(some(F.col("body"))), F.lit(limit)) + 30).alias("cost"))
    lines = first_rows(each, [F.asc("ordinal"), F.asc_nulls_first("line"), F.asc("cost")], top).select("thread", "place", "line", "cost")
    return _with_bodies(bodies, "body", comment_chunks(lines, headers, title="## Comments", gap="\n\n", single=single, most=most, last=""))


def repository_text(url_parts: Column, text: Column) -> Column:
    """The text of a repository's file below the heading that names it; url_parts is sites.repository()."""
    label = F.when(url_parts.isNotNull(), F.concat_ws("/", url_parts["owner"], url_parts["repo"])).otherwise("(unknown repo)")
    return F.when(F.trim(text) != "", F.concat(F.lit("# GitHub: "), label, F.lit(" — "), F.coalesce(url_parts["path"], F.lit("README")), F.lit("\n\n"), text))


def repository_subjects(url_parts: Column) -> Column:
    return F.array_compact(F.array(url_parts["repo"], F.concat(F.lit("github:"), url_parts["owner"])))


def missing_commenters(claims: DataFrame, comments: DataFrame, least_tokens: int = 5) -> DataFrame:
    """thread, login, content, confidence, subjects: a claim for everybody whose
    comment has substance and whom no claim names.

    claims(thread, subjects), comments(thread, ordinal, login, body, tokens):
    the first comment of a login with at least so many distinct tokens counts.
    """
    named = claims.select("thread", F.explode("subjects").alias("subject")).distinct()
    some = comments.where((F.coalesce("login", F.lit("")) != "") & (F.trim(F.coalesce("body", F.lit(""))) != "") & (F.size("tokens") >= least_tokens))
    first = some.groupBy("thread", "login").agg(F.min_by("body", "ordinal").alias("body")).withColumn("subject", F.concat(F.lit("github:"), "login"))
    body = stripped(F.col("body"))
    snippet = F.when(F.length(body) <= 300, body).otherwise(F.concat(F.left(body, F.lit(297)), F.lit("...")))
    out = first.join(named, ["thread", "subject"], "left_anti")
    return out.select("thread", "login", F.concat(F.lit("@"), "login", F.lit(' commented on this gist: "'), snippet, F.lit('"')).alias("content"), F.lit(0.85).alias("confidence"), F.array("subject").alias("subjects"))


def story_claims(stories: DataFrame) -> DataFrame:
    """thread, content, confidence, properties (JSON) of stories(thread, id, title, by, score, url, descendants): one claim on each."""
    score, replies = F.coalesce("score", F.lit(0)).cast("long"), F.coalesce("descendants", F.lit(0)).cast("long")
    title = F.when(F.coalesce("title", F.lit("")) == "", "untitled").otherwise(F.col("title"))
    content = F.concat(F.lit("Hacker News thread '"), title, F.lit("' by hn/"), "by", F.lit(" received "), score.cast("string"), F.lit(" points and "), replies.cast("string"), F.lit(" comments."))
    values = {"hn:hasPoints": score, "hn:hasAuthor": F.col("by"), "hn:hasItemId": F.col("id"), "hn:hasCommentCount": replies, "social:hasScore": score, "social:hasReplyCount": replies, "social:hasAuthorHandle": F.col("by"), "content:hasUrl": F.col("url"), "thread:hasRootId": F.col("id")}
    return stories.where((F.coalesce("by", F.lit("")) != "") & F.col("id").isNotNull()).select("thread", content.alias("content"), F.lit(0.95).alias("confidence"), _json(values).alias("properties"))


def status_claims(statuses: DataFrame) -> DataFrame:
    """thread, content, confidence, properties (JSON): one claim on each status.

    statuses(thread, id, account, instance, favourites, boosts, replies,
    warning, language, card_url, parent, root, boosted struct(id, account, uri));
    what isn't known isn't in the properties.
    """
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    favourites, boosts, replies = (count_or_zero(F.col(c)) for c in ("favourites", "boosts", "replies"))
    warning, is_boost = some(F.trim("warning")), F.col("boosted").isNotNull()
    root = F.coalesce(some(F.col("root")), F.col("parent"), F.col("id"))
    values = {
        "mastodon:hasFavouritesCount": favourites, "mastodon:hasReblogsCount": boosts, "mastodon:hasRepliesCount": replies, "mastodon:hasInstance": F.col("instance"), "mastodon:hasAccountHandle": F.col("account"),
        "mastodon:hasStatusId": F.col("id"), "mastodon:isReblog": is_boost, "social:hasScore": favourites, "social:hasReplyCount": replies, "social:hasReactionCount": boosts, "social:hasAuthorHandle": F.col("account"),
        "thread:hasRootId": root, "mastodon:hasSpoilerText": warning, "content:hasLanguage": some(F.col("language")), "content:hasUrl": some(F.col("card_url")), "thread:hasParentId": F.col("parent"),
        "mastodon:reblogOfStatusId": some(F.col("boosted.id")), "mastodon:reblogOfAccountAcct": some(F.col("boosted.account")), "mastodon:reblogOfStatusUri": some(F.col("boosted.uri")),
    }
    note = F.concat(F.when(is_boost, " (boost)").otherwise(""), F.when(warning.isNotNull(), F.concat(F.lit(" [CW: "), warning, F.lit("]"))).otherwise(""))
    content = F.concat(F.lit("Mastodon status by mastodon/"), "account", F.lit(" on "), F.coalesce(some(F.col("instance")), F.lit("unknown")), note, F.format_string(" received %d favourites, %d boosts, %d replies.", favourites, boosts, replies))
    return statuses.where(some(F.col("id")).isNotNull() & some(F.col("account")).isNotNull()).select("thread", content.alias("content"), F.lit(0.95).alias("confidence"), _json(values).alias("properties"))


def _json(values: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))
