"""Deposited threads from their JSON to chunks and claims."""

from __future__ import annotations

import json

from factloom.operators import chunks, deposits


def table(spark, *documents):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "k long, blob string")


def test_news(spark):
    story = {"id": 7, "title": "T", "by": "me", "score": 3, "kids": [2, 1, 99], "descendants": 3}
    comments = {"1": {"id": 1, "by": "a", "text": "one"}, "2": {"id": 2, "by": "b", "text": "two", "kids": [3], "dead": True}, "3": {"id": 3, "text": "three\nlines"}, "4": {"id": 4, "text": "lost"}}
    stories, found = deposits.news(table(spark, {"story": story, "comments": comments}, "{", {"story": None}), "k", "blob")
    got = {r.chunk_id: r.chunk for r in chunks.news_chunks(stories, found).collect()}
    assert got == {"story": "HACKER NEWS THREAD: T\nPosted by hn/me [score: 3]", "comments": "# Context: comments on Hacker News thread — T\nCOMMENTS:\n  hn/anon: three lines\nhn/a: one"}
    assert [r.content for r in chunks.story_claims(stories).collect()] == ["Hacker News thread 'T' by hn/me received 3 points and 3 comments."]


def test_forum(spark):
    reply = lambda body, score, *below: {"kind": "t1", "data": {"author": "u", "score": score, "body": body, "replies": {"data": {"children": list(below)}} if below else ""}}
    tree = [reply("low", 1, reply("deep", 9)), {"kind": "more", "data": {}}, reply("[deleted]", 5), reply("good", 9)]
    document = [{"data": {"children": [{"data": {"subreddit": "s", "title": "P", "author": "a", "score": 4, "selftext": " text "}}]}}, {"data": {"children": tree}}]
    posts, found = deposits.forum(table(spark, document, "[]", "null", "x"), "k", "blob")
    got = {r.chunk_id: r.chunk for r in chunks.forum_chunks(posts, found).collect()}
    assert got == {"body": "REDDIT THREAD: r/s — P\nPosted by u/a [score: 4]\n\ntext", "comments": "# Context: comments on r/s thread — P\nTOP COMMENTS:\n[score:9] u/u: good\n[score:9] u/u: deep"}


def test_statuses(spark):
    status = lambda i, to, text, **more: {"id": i, "in_reply_to_id": to, "content": f"<p>{text}</p>", "account": {"acct": f"a{i}"}, "favourites_count": 1, **more}
    document = {"instance": "x.social", "status": status("5", "4", "Hi &amp; bye", card={"url": "http://c"}), "ancestors": [status("3", None, "root"), status("4", "3", "up")], "descendants": [status("7", "6", "deep"), status("6", "5", "first", spoiler_text="cw"), status("8", "404", "lost")]}
    own, replies = deposits.statuses(table(spark, document, "[]", {"status": {}}), "k", "blob")
    got = {r.chunk_id: r.chunk for r in chunks.status_chunks(own, replies).collect()}
    assert got["status"].startswith("CONTEXT (ancestors, oldest first):\nmastodon/a3: root\nmastodon/a4: up\n\nMASTODON THREAD on x.social\nPosted by mastodon/a5 [favourites: 1, boosts: 0, replies: 0]\n\nHi & bye")
    assert got["replies"] == "# Context: replies on Mastodon thread — Hi & bye\nREPLIES:\nmastodon/a6: [CW: cw] first\n  mastodon/a7: deep"
    claim = chunks.status_claims(own).first()
    assert '"thread:hasRootId":"3"' in claim.properties and '"content:hasUrl":"http://c"' in claim.properties and '"thread:hasParentId":"4"' in claim.properties
