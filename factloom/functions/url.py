"""URL canonicalisation and harvesting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

#: Query parameters that never change the resource, and their prefixes.
TRACKING = (
    "fbclid", "gclid", "dclid", "gclsrc", "msclkid", "yclid", "mc_eid", "mc_cid", "igshid", "igsh", "_hsenc", "_hsmi", "vero_id",
    "oly_enc_id", "oly_anon_id", "ref", "ref_src", "ref_url", "referrer", "spm", "scm", "s_cid", "cmpid", "ncid", "soc_src", "soc_trk",
)
TRACKING_PREFIXES = ("utm_", "ga_", "_ga", "pk_", "mtm_", "hsa_", "matomo_")
#: URLs in prose, and punctuation that clings to them.
URL = r"(?i)https?://[^\s\"'<>)\]}`]+"
CLINGING = ".,;:!?’\"')]}>"
#: Wrappers that are taken off one after the other, at most.
MOST_WRAPPERS = 3

_CLASS = r"[.,;:!?’\"')\]}>]+"
_PARTS = r"(?i)^(https?)://(?:[^/?#]*@)?([^/?#:@]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _trimmed(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), f"^{_CLASS}|{_CLASS}$", "")
    return F.when(bare != "", bare)


def _decoded(part: Column) -> Column:
    """The part without escapes and with + for a blank undone; as it is where an escape is broken."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Escaped for a query: letters, digits, - . _ ~ stay, a blank is +."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def stripped_query(query: Column) -> Column:
    """The query without tracking parameters; order and repeats stay, escapes are made anew."""

    def name(p: Column) -> Column:
        return _decoded(F.substring_index(p, "=", 1))

    def tracking(p: Column) -> Column:
        return let(F.lower(name(p)), lambda n: n.isin(list(TRACKING)) | F.exists(F.array(*[F.lit(x) for x in TRACKING_PREFIXES]), lambda x: F.startswith(n, x)))

    def again(p: Column) -> Column:
        value = F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("")
        return F.concat(_encoded(name(p)), F.lit("="), _encoded(_decoded(value)))

    return F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracking(p)), again), "&")


def _target(url: Column) -> Column:
    """What a redirect, a viewer or a cache URL holds, or null."""
    host, path, query = F.lower(_part(url, 2)), _part(url, 4), _part(url, 5)
    google = (host == "google.com") | host.endswith(".google.com")
    cache = (host == "cdn.ampproject.org") | host.endswith(".cdn.ampproject.org")

    def named(key: str) -> Column:
        value = _decoded(F.regexp_extract(query, f"(?:^|&){key}=([^&]+)", 1))
        return let(_decoded(F.replace(value, F.lit("+"), F.lit("%2B"))), lambda v: F.when(v.startswith("http://") | v.startswith("https://"), v))

    def below(prefix: str) -> Column:
        rest = F.regexp_extract(path, f"^/{prefix}/(?:s/)?(.+)$", 1)
        secure = path.rlike(f"^/{prefix}/s/.")
        full = F.concat(F.when(secure, "https://").otherwise("http://"), rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
        return F.when(rest != "", full)

    return F.coalesce(F.when(google & (path == "/url"), F.coalesce(named("q"), named("url"))), F.when(google, below("amp")), F.when(cache, below("c")))


def unwrapped(url: Column) -> Column:
    """The target inside a redirect, viewer or cache URL, wrapped at most MOST_WRAPPERS times, else the URL; trimmed."""
    out = _trimmed(url)
    for _ in range(MOST_WRAPPERS):
        out = let(out, lambda u: let(_target(u), lambda t: F.when(t.isNotNull() & (t != u), _trimmed(t)).otherwise(u)))
    return out


def canonical(url: Column) -> Column:
    """The URL without wrappers, scheme and host in lower case, without
    credentials, default port, fragment, tracking parameters and trailing
    slashes; null if it isn't http(s) or has no host."""

    def plain(u: Column) -> Column:
        scheme, host, port, path, query = F.lower(_part(u, 1)), F.rtrim(F.lower(_part(u, 2)), F.lit(".")), _part(u, 3), _part(u, 4), _part(u, 5)
        standard = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        cut = let(F.regexp_replace(path, "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
        rest = let(stripped_query(query), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        full = F.concat(scheme, F.lit("://"), host, F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), cut, rest)
        return F.when(host != "", full)

    return let(unwrapped(url), plain)


def harvested(text: Column) -> Column:
    """Distinct canonical URLs of a text, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, canonical), lambda u: u.isNotNull()))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))
