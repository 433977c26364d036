"""Personal data by patterns, checksums and context, in Spark SQL only.

Patterns propose spans, checksums (Luhn, mod 97), counts and ranges confirm
them, and words near a span move its score. Matches and the gaps between them
come from one pattern each; the place of a match is the sum of what lies before
it. No Python runs on the executors.

Patterns are written with possessive repeats and a look at the character before
where that leaves the matches as they are: then no text costs more than a few
passes over it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gaps whose lengths are summed at once, so that places cost linear time.
_STEP = 64
#: Characters next to a span in which context words count.
NEAR = 40
#: Score from which a span of the added kinds is one.
LEAST = 0.5
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return total + F.when((n - i) % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits pass the check of international account numbers."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _is_ip(s: Column) -> Column:
    def small(part: Column) -> Column:
        return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))

    return F.forall(F.split(s, "[.]"), small)


def _is_card(s: Column) -> Column:
    return let(_digits(s), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def _is_phone(s: Column) -> Column:
    return F.length(_digits(s)).between(8, 15)


def _is_account(s: Column) -> Column:
    return let(F.regexp_replace(s, " ", ""), lambda a: F.when(F.length(a).between(15, 34), mod97(a)).otherwise(False))


class Kind:
    """A kind of personal data: pattern, what texts must hold, what confirms a
    match, the score of a confirmed one, context words that raise or lower it,
    and the part of the match that is the span (to its end)."""

    def __init__(self, name: str, pattern: str, holds: tuple[str, ...], confirms: Callable[[Column], Column], score: float, raises: str, lowers: str = "", base: bool = True, part: str = "") -> None:
        self.name, self.pattern, self.holds, self.confirms = name, pattern, holds, confirms
        self.score, self.raises, self.lowers, self.base, self.part = score, raises, lowers, base, part


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), lambda s: F.lit(True), 0.9, "mail|contact|write|from|to:"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), _is_ip, 0.6, "ip|addr|host|server|login|client", "version|release|build|section"),
    Kind("card", r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+", (), _is_card, 0.8, "card|visa|master|amex|credit|debit|cvv|pay", "order|invoice|serial|isbn"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), _is_phone, 0.6, "tel|phone|call|fax|mobile|cell|whatsapp"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", (), _is_account, 0.8, "iban|account|konto|compte|cuenta|bank|bic", base=False),
    Kind("secret", r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9+/_=-]{16,}", ("token", "secret", "passw", "api"), lambda s: s.rlike("[0-9]"), 0.6, "key|auth|login|bearer|config|env", "example|dummy|sample", base=False, part="[A-Za-z0-9+/_=-]{16,}$"),
)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    score = F.lit(kind.score) + F.when(near.rlike(kind.raises), 0.1).otherwise(0.0)
    return F.round(score - F.when(near.rlike(kind.lowers), 0.2).otherwise(0.0) if kind.lowers else score, 3)


def _none() -> Column:
    return F.array().cast(SPANS)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order."""
    pattern = F.lit(kind.pattern)

    def located(parts: Column, found: Column) -> Column:
        steps = F.zip_with(found, parts, lambda f, p: F.coalesce(F.length(f), F.lit(0)).cast("long") + F.length(p))
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _STEP).cast("int"))

        def with_sums(lengths: Column) -> Column:
            sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * _STEP + 1, F.lit(_STEP)), F.lit(0).cast("long"), lambda a, x: a + x))
            starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
            return let(starts, lambda blocks_at: with_blocks(lengths, blocks_at))

        def with_blocks(lengths: Column, blocks_at: Column) -> Column:
            def span(i: Column) -> Column:
                b = F.floor(i / _STEP).cast("int")
                before = F.aggregate(F.slice(lengths, b * _STEP + 1, i % _STEP), blocks_at[b], lambda a, x: a + x)
                end = before + F.length(parts[i]) + F.length(found[i])
                size = F.length(F.regexp_extract(found[i], kind.part, 0)) if kind.part else F.length(found[i])
                return let(end, lambda e: F.struct(F.lit(kind.name).alias("kind"), (e - size).alias("start"), e.alias("end"), _score(kind, parts[i], parts[i + 1]).alias("score")))

            good = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: kind.confirms(found[i]))
            return F.transform(good, span)

        return let(steps, with_sums)

    def split(found: Column) -> Column:
        some = F.exists(found, kind.confirms)
        return F.when(some, let(F.split(text, kind.pattern, -1), lambda parts: located(parts, found))).otherwise(_none())

    out = let(F.regexp_extract_all(text, pattern, F.lit(0)), split)
    if kind.holds:
        held = [F.lower(text).contains(x) if x.isalpha() else text.contains(x) for x in kind.holds]
        out = F.when(reduce(or_, held), out).otherwise(_none())
    return out if kind.base else F.filter(out, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and spans (kind, start, end, score), by kind as
    in KINDS and then by start; places are code points, the end exclusive.

    A null or empty text has no spans; a text of any length is read whole, in a
    few passes. Rows are judged one by one, repeated ones alike; other columns
    of docs, whatever their names, play no part. Base kinds stay whatever their score; iban and secret
    spans need a score of LEAST.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.concat(*[spans_of(F.col("text"), k) for k in KINDS]).alias("spans"))


def redacted(text: Column) -> Column:
    """The text with every confirmed span replaced by its kind in brackets.

    Kind after kind, the widest first, so that a number inside another span is
    gone with it. Null stays null.
    """
    by_name = {k.name: k for k in KINDS}
    for name in ("email", "iban", "card", "phone", "ip", "secret"):
        text = _replaced(text, by_name[name])
    return text


def _replaced(text: Column, kind: Kind) -> Column:
    mark = f"[{kind.name.upper()}]"

    def put(t: Column, found: Column) -> Column:
        def new(f: Column) -> Column:
            return F.regexp_replace(f, kind.part, mark) if kind.part else F.lit(mark)

        pieces = F.zip_with(F.split(t, kind.pattern, -1), found, lambda p, f: F.concat(p, F.when(f.isNull(), "").when(kind.confirms(f), new(f)).otherwise(f)))
        return F.array_join(pieces, "")

    def replaced(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda found: F.when(F.exists(found, kind.confirms), put(t, found)).otherwise(t))

    return let(text, replaced)
