"""Deposited threads, one JSON document each, as the tables that chunks and claims are made from.

A document that isn't such a thread gives no rows.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.shared import bounded_batches

_ITEM = "id:long,`by`:string,text:string,dead:boolean,deleted:boolean,score:long,kids:array<long>"
NEWS = f"story struct<{_ITEM},title:string,url:string,descendants:long>, comments map<string,struct<{_ITEM}>>"
_STATUS = "id:string,uri:string,content:string,spoiler_text:string,language:string,in_reply_to_id:string,favourites_count:long,reblogs_count:long,replies_count:long,account:struct<acct:string>,card:struct<url:string>,reblog:struct<id:string,uri:string,content:string,account:struct<acct:string>>"
STATUSES = f"instance string, status struct<{_STATUS}>, ancestors array<struct<{_STATUS}>>, descendants array<struct<{_STATUS}>>"
_FORUM = "post string, rows array<struct<id:long,parent:long,ordinal:long,kind:string,author:string,score:long,body:string>>"


def news(documents: DataFrame, key: str, blob: str) -> tuple[DataFrame, DataFrame]:
    """(stories, comments) of news threads: a comment hangs below whatever lists it among its kids, in their order."""
    rows = documents.select(F.col(key).alias("thread"), F.from_json(blob, NEWS).alias("d")).where("d.story IS NOT NULL")
    stories = rows.select("thread", "d.story.id", "d.story.title", "d.story.by", "d.story.score", "d.story.url", "d.story.text", "d.story.descendants")
    listed = rows.select("thread", F.lit(None).cast("long").alias("parent"), F.posexplode("d.story.kids").alias("ordinal", "id"))
    each = rows.select("thread", F.explode("d.comments").alias("id", "c")).withColumn("id", F.col("id").try_cast("long"))
    below = each.select("thread", F.col("id").alias("parent"), F.posexplode("c.kids").alias("ordinal", "id"))
    comments = listed.unionByName(below).join(each, ["thread", "id"])
    return stories, comments.select("thread", "id", "parent", "ordinal", "c.by", "c.text", "c.dead", "c.deleted", "c.score")


def forum(documents: DataFrame, key: str, blob: str) -> tuple[DataFrame, DataFrame]:
    """(posts, comments) of forum threads, whose replies are nested to any depth; ids number a thread's comments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(n, pa.string() if n in ("kind", "author", "body") else pa.int64()) for n in ("id", "parent", "ordinal", "kind", "author", "score", "body")]
        for b in batches:
            found = [_nested(text) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([r for _, r in found], pa.list_(pa.struct(fields)))], names=["thread", "post", "rows"])

    rows = documents.select(F.col(key).alias("thread"), blob)
    bounded_batches(rows.sparkSession)
    rows = rows.mapInArrow(read, T.StructType([rows.schema["thread"], *T.StructType.fromDDL(_FORUM)])).where("post IS NOT NULL")
    said = lambda n: F.get_json_object("post", f"$.{n}")
    posts = rows.select("thread", said("subreddit").alias("forum"), said("title").alias("title"), said("author").alias("author"), said("score").try_cast("long").alias("score"), said("selftext").alias("text"))
    return posts, rows.select("thread", F.explode("rows").alias("r")).select("thread", "r.*")


def _nested(text: str | None) -> tuple[str | None, list[dict]]:
    """(the post's JSON, its comments in breadth-first order with their parents' numbers)."""
    try:
        data = json.loads(text or "")
        post = data[0]["data"]["children"][0]["data"]
    except (json.JSONDecodeError, IndexError, KeyError, TypeError):
        return None, []
    if not isinstance(post, dict):
        return None, []
    out, todo = [], deque((None, i, c) for i, c in enumerate(_children(data[1] if len(data) > 1 else None)))
    while todo:
        parent, ordinal, node = todo.popleft()
        comment = node.get("data") if isinstance(node, dict) else None
        if not isinstance(comment, dict):
            continue
        score = comment.get("score", 0)
        out.append({"id": len(out), "parent": parent, "ordinal": ordinal, "kind": node.get("kind"), "author": str(comment.get("author", "")), "score": score if isinstance(score, int) else 0, "body": str(comment.get("body") or "")})
        todo.extend((len(out) - 1, i, c) for i, c in enumerate(_children(comment.get("replies"))))
    return json.dumps(post), out


def _children(listing: object) -> list:
    data = listing.get("data") if isinstance(listing, dict) else None
    found = data.get("children") if isinstance(data, dict) else None
    return found if isinstance(found, list) else []


def statuses(documents: DataFrame, key: str, blob: str) -> tuple[DataFrame, DataFrame]:
    """(statuses, replies) of status threads, for chunks and claims: a reply to the status itself has no parent."""
    rows = documents.select(F.col(key).alias("thread"), F.from_json(blob, STATUSES).alias("d")).where("d.status.id IS NOT NULL")
    boosted = lambda s: F.when(s["reblog"].isNotNull(), F.struct(s["reblog"]["id"].alias("id"), s["reblog"]["account"]["acct"].alias("account"), s["reblog"]["uri"].alias("uri"), s["reblog"]["content"].alias("content")))
    above = F.transform(F.coalesce("d.ancestors", F.array().cast(f"array<struct<{_STATUS}>>")), lambda a: F.struct(a["account"]["acct"].alias("account"), a["content"].alias("content"), boosted(a).alias("boosted"), a["spoiler_text"].alias("warning")))
    s = F.col("d.status")
    own = rows.select(
        "thread", "d.instance", s["id"].alias("id"), s["account"]["acct"].alias("account"), s["content"].alias("content"), boosted(s).alias("boosted"), s["spoiler_text"].alias("warning"), s["favourites_count"].alias("favourites"), s["reblogs_count"].alias("boosts"), s["replies_count"].alias("replies"),
        s["language"].alias("language"), s["card"]["url"].alias("card_url"), s["in_reply_to_id"].alias("parent"), F.get(F.col("d.ancestors.id"), F.lit(0)).alias("root"), above.alias("above"),
    )
    r = rows.select("thread", s["id"].alias("own"), F.posexplode("d.descendants").alias("ordinal", "r"))
    parent = F.when(F.col("r.in_reply_to_id") != F.col("own"), F.col("r.in_reply_to_id"))
    replies = r.where("r.in_reply_to_id IS NOT NULL").select("thread", "r.id", parent.alias("parent"), "ordinal", F.col("r.account.acct").alias("account"), "r.content", boosted(F.col("r")).alias("boosted"), F.col("r.spoiler_text").alias("warning"), F.col("r.favourites_count").alias("favourites"))
    return own, replies
