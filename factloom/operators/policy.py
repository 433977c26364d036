"""Trust policies and conformance checks over claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import url_rules


def skeptical_ranks(statements: DataFrame) -> DataFrame:
    """domain, source_type, trust_rank: the lowest of all lenses; silence is neutral."""
    return statements.groupBy("domain", "source_type").agg(F.min("trust_rank").alias("trust_rank"))


def with_trust(claims: DataFrame, statements: DataFrame, rules: DataFrame | None = None, url: str | None = None) -> DataFrame:
    """claims with trust: the lowest score of a rule for the host, else the rank
    of (domain, source_type), else 1; and what rules for addresses add to it.

    rules(lens, scope, pattern, score, modifier): scope domain has a score for a
    host, scope url_pattern a modifier for the addresses (column ``url``) in
    which its regular expression is found. The modifiers of a lens add up, the
    lens that takes most away counts, and trust stays from 0 to 1.
    """
    ranked = claims.join(skeptical_ranks(statements), ["domain", "source_type"], "left")
    trust, change = F.coalesce("trust_rank", F.lit(1.0)), F.lit(0.0)
    if rules is not None:
        hosts = rules.where("scope = 'domain'").groupBy(F.col("pattern").alias("host")).agg(F.min("score").alias("url_score"))
        ranked = ranked.join(hosts, "host", "left")
        trust = F.coalesce("url_score", trust)
        if url:
            patterns = rules.where("scope = 'url_pattern'").select("lens", "pattern", "modifier")
            met = url_rules.matches(claims.select(url), patterns, url).join(patterns, "pattern").groupBy("url", "lens").agg(F.sum("modifier").alias("change")).groupBy(F.col("url").alias(url)).agg(F.min("change").alias("url_change"))
            ranked = ranked.join(met, url, "left")
            change = F.coalesce("url_change", F.lit(0.0))
    return ranked.withColumn("trust", F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust + change))).drop("trust_rank", "url_score", "url_change")


#: Closed vocabularies of a claim's fields.
VOCABULARIES = {
    "status": ("ACTIVE", "SUPERSEDED", "RETRACTED", "INCONSISTENCY", "PROVENANCE_STALE"),
    "uncertainty_nature": ("EPISTEMIC", "ALEATORY"),
}


def violations(required: dict[str, Column], unit: dict[str, Column], enums: dict[str, Column]) -> Column:
    """Names of the rules a claim breaks: missing:<field>, range:<field>, enum:<field>."""
    checks = [F.when(x.isNull() | (x.cast("string") == ""), f"missing:{n}") for n, x in required.items()]
    checks += [F.when(~x.between(0, 1), f"range:{n}") for n, x in unit.items()]
    checks += [F.when(~x.isin(*VOCABULARIES[n]), f"enum:{n}") for n, x in enums.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def field_statistics(claims: DataFrame, fields: dict[str, Column], least: float = 0.8) -> DataFrame:
    """field, populated, n, rate, enough of each field, in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(x, F.lit(False)).alias("has")) for n, x in fields.items()])
    out = claims.select(F.explode(each).alias("x")).groupBy("x.field").agg(F.count_if("x.has").alias("populated"), F.count("*").alias("n"))
    return out.withColumn("rate", F.col("populated") / F.col("n")).withColumn("enough", F.col("rate") >= least)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
