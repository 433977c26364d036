"""Text normalisation, keys, gates and small parsers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation dropped from the end of a claim, and sentence ends.
TRAILING = ".,;:!?\"'"
SENTENCE_END = r"[.!?]+(?:\s|$)"
#: Shapes of names that are no entities.
REFERENCE_CODE = r"^[A-Z0-9]+(?:[ ._/\-][A-Z0-9]+)+$"
FILE_NAME = r"(?i)\.(?:md|markdown|rst|txt|py|pyi|ipynb|json|jsonld|ya?ml|toml|ttl|cfg|ini|sh|bash|zsh|js|ts|tsx|jsx|rs|go|c|h|cpp|java|rb|html?|csv|tsv|lock|cff)$"
SNAKE_CASE = r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"
CLI_WORD = r"(?:[a-z][a-z0-9-]*|--?[a-z0-9][a-z0-9-]*)"


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized_content(content: Column) -> Column:
    """White space collapsed, trailing punctuation and blanks dropped; case stays."""
    squeezed = F.trim(F.regexp_replace(content, r"(?U)\s+", " "))
    return F.rtrim(F.regexp_replace(squeezed, r"[.,;:!?\"']+$", ""))


def content_hash(content: Column) -> Column:
    return F.sha2(normalized_content(content), 256)


def dedup_key(content: Column) -> Column:
    """Lower-case letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(content), "[^a-z0-9 ]+", " "), r"\s+", " "))


def sentence_count(content: Column) -> Column:
    return F.size(F.filter(F.split(content, SENTENCE_END), lambda s: F.trim(s) != ""))


def granularity_violation(content: Column, max_chars: int, max_sentences: int) -> Column:
    """What makes a claim too long, or null; a limit of 0 is none."""
    chars = F.length(content) > max_chars if max_chars else F.lit(False)
    sentences = sentence_count(content) > max_sentences if max_sentences else F.lit(False)
    return F.when(chars, "chars").when(sentences, "sentences")


def non_entity_class(name: Column, vocabulary: tuple[str, ...] = (), binaries: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> Column:
    """Class of a name that is no real-world entity, or null; the first that fits."""
    n = F.trim(name)
    command = n.rlike("^(?:" + "|".join(binaries) + r")(?:\s+" + CLI_WORD + ")+$") if binaries else F.lit(False)
    return (
        F.when((n == "") | n.isin(list(allowed)), None)
        .when(n.isin(list(vocabulary)), "self_vocabulary")
        .when((F.length(n) <= 32) & n.rlike("[0-9]") & n.rlike(REFERENCE_CODE), "reference_code")
        .when(n.rlike(FILE_NAME), "filename")
        .when(command, "cli_command")
        .when(n.rlike(SNAKE_CASE), "snake_case")
    )


def pretty_local_name(iri: Column) -> Column:
    """The last part of an IRI as words: camel case, underscores and dashes split."""
    tail = F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))
    spaced = F.regexp_replace(F.regexp_replace(tail, r"(?<=[a-z0-9])(?=[A-Z])", " "), "[_-]+", " ")
    words = F.filter(F.split(spaced, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.lower(w))), " ")


def file_name(name: Column) -> Column:
    """A name that any file system takes."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "-")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.\.+", "-"), "-{2,}", "-")
    clean = F.regexp_replace(F.trim(clean), r"^\.+", "")
    return F.when(F.upper(clean).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"), F.concat(F.lit("_"), clean)).when(clean == "", "_").otherwise(clean)


def ticker(title: Column, stop: tuple[str, ...]) -> Column:
    """The first word of 2 to 5 capitals that isn't a stop word, or null."""
    return F.get(F.filter(F.regexp_extract_all(title, F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0)), lambda t: ~t.isin(list(stop))), F.lit(0))


def content_tokens(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct lower-case words of four letters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def short_id(claim_id: Column) -> Column:
    return F.substring(claim_id, 1, 8)


def media_type(content: Column) -> Column:
    """Image type by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def looks_like_html(content: Column) -> Column:
    return F.lower(F.substring(content, 1, 1024).cast("string")).rlike("<!doctype html|<html")
