"""Addresses of sites that claims come from, taken apart; names of their people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of addresses.
HN_ITEM = r"^https?://news\.ycombinator\.com/item\?(?:[^#]*&)?id=(\d+)(?:&[^#]*)?$"
HN_API = r"^https?://hacker-news\.firebaseio\.com/v0/item/(\d+)\.json(?:\?.*)?$"
STATUS = r"^https?://([^/]+)/@([A-Za-z0-9_]+)(?:@([A-Za-z0-9_.\-]+))?/(\d+)(?:[/?#].*)?$"
STATUS_API = r"^https?://([^/]+)/api/v1/statuses/(\d+)(?:\?.*)?$"
REPO_FILE = r"^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+?)(?:[?#].*)?$"
REPO_ROOT = r"^https?://github\.com/([^/]+)/([^/]+)/?(?:[?#].*)?$"
RAW_FILE = r"^https?://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/(.+?)(?:[?#].*)?$"
GIST = r"^https?://gist\.github\.com/([^/]+)/([a-f0-9]+)/?(?:[?#].*)?$"
PAGES = r"^https?://([A-Za-z0-9][A-Za-z0-9-]*)\.github\.io(/.*)?$"
FORUM_POST = r"^/r/([^/]+)/comments/([^/]+)(?:/([^/]+))?"
DAY_IN_PATH = r"/(\d{4})/(\d{2})/(\d{2})(?:/|$)"
LOGIN = r"[A-Za-z0-9][A-Za-z0-9-]{0,38}"
PEOPLE = {"hn": r"\bhn/([A-Za-z0-9_-]{2,32})\b", "mastodon": r"\bmastodon/([A-Za-z0-9_]+(?:@[A-Za-z0-9_.\-]+)?)\b", "u": r"\bu/([A-Za-z0-9_-]{3,20})\b", "r": r"\br/([A-Za-z0-9_]{1,21})\b", "gh": rf"\bgh/({LOGIN})\b"}


def _group(url: Column, shape: str, i: int) -> Column:
    """Group i where the shape fits and the group isn't empty, else null."""
    value = F.regexp_extract(url, shape, i)
    return F.when(value != "", value)


def item_id(url: Column) -> Column:
    """The number of a news item, from its page or its API address."""
    return F.coalesce(_group(url, HN_ITEM, 1), _group(url, HN_API, 1)).cast("long")


def status_route(url: Column) -> Column:
    """struct(instance, id, account) of a status: the home instance of its author; null if it is none."""
    user, remote = _group(url, STATUS, 2), _group(url, STATUS, 3)
    page = F.struct(F.coalesce(remote, _group(url, STATUS, 1)).alias("instance"), _group(url, STATUS, 4).alias("id"), F.when(remote.isNotNull(), F.concat_ws("@", user, remote)).otherwise(user).alias("account"))
    api = F.struct(_group(url, STATUS_API, 1).alias("instance"), _group(url, STATUS_API, 2).alias("id"), F.lit(None).cast("string").alias("account"))
    return F.when(url.rlike(STATUS), page).when(url.rlike(STATUS_API), api)


def from_raw(url: Column) -> Column:
    """The page of a raw file; other addresses stay."""
    return F.regexp_replace(url, RAW_FILE, "https://github.com/$1/$2/blob/$3/$4")


def repository(url: Column) -> Column:
    """struct(owner, repo, branch, path) of a repository's page or file; null if it is none."""
    part = lambda i: F.coalesce(_group(url, REPO_FILE, i), _group(url, REPO_ROOT, i) if i < 3 else F.lit(None).cast("string"))
    return F.when(url.rlike(REPO_FILE) | url.rlike(REPO_ROOT), F.struct(*[part(i).alias(n) for i, n in enumerate(("owner", "repo", "branch", "path"), 1)]))


def gist(url: Column) -> Column:
    return F.when(url.rlike(GIST), F.struct(_group(url, GIST, 1).alias("user"), _group(url, GIST, 2).alias("id")))


def user_page(url: Column) -> Column:
    """struct(user, path) of a page below a user's own host; the path may be empty."""
    return F.when(url.rlike(PAGES), F.struct(_group(url, PAGES, 1).alias("user"), F.regexp_extract(url, PAGES, 2).alias("path")))


def forum_permalink(url: Column) -> Column:
    """A forum address on the forum's main host: a post's without comment, query and fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:]*)", 1)), r"^(?:www\.|old\.)?reddit\.com$", "www.reddit.com")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    slug = _group(path, FORUM_POST, 3)
    post = F.concat(F.lit("/r/"), _group(path, FORUM_POST, 1), F.lit("/comments/"), _group(path, FORUM_POST, 2), F.lit("/"), F.coalesce(F.concat(slug, F.lit("/")), F.lit("")))
    return F.concat(F.lit("https://"), host, F.coalesce(post, path))


def day_in_path(url: Column) -> Column:
    """The date that a path names as /year/month/day/, as DATE; null if there is none or it doesn't exist."""
    return F.concat_ws("-", *[_group(url, DAY_IN_PATH, i) for i in (1, 2, 3)]).try_cast("date")


def mentioned(chunks: Column, kind: str) -> Column:
    """Distinct names that an array of chunks writes with a site's mark (a key of PEOPLE)."""
    return F.array_distinct(F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit(PEOPLE[kind]), F.lit(1)))))


def marked_names(subjects: Column, known: dict[str, Column], marks: dict[str, str] | None = None) -> Column:
    """subjects, each bare name that is known written with its mark, without repeats.

    known: for each kind the names that the source holds; the first kind that
    has a name wins. marks: what a kind is written with, else ``kind/``. A name
    that already has the mark of a kind gets the kind's mark as well.
    """
    marks = {k: f"{k}/" for k in known} | (marks or {})

    def written(s: Column) -> Column:
        out = s
        for kind, names in reversed(known.items()):
            out = F.when(F.array_contains(names, s), F.concat(F.lit(marks[kind]), s)).otherwise(out)
        for kind in known:
            has = F.startswith(s, F.lit(f"{kind}/"))
            rest = F.substring(s, F.lit(len(kind) + 2), F.length(s))
            fits = F.lit(True) if kind != "gh" else rest.rlike(f"^{LOGIN}$")
            out = F.when(has, F.when(fits, F.concat(F.lit(marks[kind]), rest)).otherwise(s)).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(subjects, written), lambda s: s != ""))


def mentions_written_out(content: Column) -> Column:
    """gh/name as @name."""
    return F.regexp_replace(content, PEOPLE["gh"], "@$1")


def with_subjects(subjects: Column, more: Column) -> Column:
    """subjects and those of more that are neither empty nor there yet."""
    return F.concat(subjects, F.array_distinct(F.filter(more, lambda s: s.isNotNull() & (s != "") & ~F.array_contains(subjects, s))))
