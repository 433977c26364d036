"""Engine passes over a store of claims: citations, curation, abstraction, precedence, dates, policies.

Each is one job with its parameters as arguments; no pass reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.confidence import age_days, clamp01, recency_of_age
from factloom.operators import url_rules
from factloom.operators.components import components


def citation_signals(mentions: DataFrame, deposited: DataFrame, now: Column, least_sources: int = 2, top: int = 20, half_life: float = 180.0, floor: float = 0.1) -> DataFrame:
    """url, sources, signal, place of what many sources cite and nobody has deposited.

    mentions(url, source, host, cited_host, trust, at): canonical URLs. A source
    counts once, with its highest trust times its decay; a URL that only its own
    host mentions is left out. The ``top`` by signal, then URL.
    """
    outside = mentions.where(F.col("host") != F.col("cited_host")).join(deposited.select("url").distinct(), "url", "left_anti")
    weight = F.col("trust") * recency_of_age(age_days(F.col("at"), now), F.lit(half_life), F.lit(floor))
    each = outside.groupBy("url", "source").agg(F.max(weight).alias("weight"))
    urls = each.groupBy("url").agg(F.count("*").alias("sources"), F.sum("weight").alias("signal")).where(F.col("sources") >= least_sources)
    first = urls.orderBy(F.desc(F.round("signal", 9)), "url").limit(top)  # a top list
    return first.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("signal", 9)), "url")))


#: Weights of dependencies, contest, age and blocked projections in a card's leverage.
LEVERAGE = (1.0, 1.0, 0.5, 1.0)


def leverage(dependents: Column, contested: Column, age: Column, blocking: Column, verdict: Column, weights: Sequence[float] = LEVERAGE, most_dependents: int = 20, oldest: float = 365.0, distinct: float = 0.1) -> Column:
    """How much a belief is worth tending: a weighted sum of signals within 0 and
    1; a pair that was judged DISTINCT sinks."""
    signals = (
        F.least(F.lit(1.0), F.log1p(dependents) / F.log1p(F.lit(float(most_dependents)))), contested.cast("double"), clamp01(age / oldest), blocking.cast("double"),
    )
    total = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in zip(signals, weights, strict=True)), F.lit(0.0))
    return F.when(verdict == "DISTINCT", total * distinct).otherwise(total)


def session(cards: DataFrame, now: Column, size: int = 7, snooze_days: int = 14) -> DataFrame:
    """The cards of a session: cards(id, leverage, snoozed_at), the first by leverage, then id; snoozed ones come back later."""
    awake = cards.where(F.col("snoozed_at").isNull() | (age_days(F.col("snoozed_at"), now) >= snooze_days))
    return awake.orderBy(F.desc(F.round("leverage", 9)), "id").limit(size)


def premise_confidence(premises: Column) -> Column:
    """Confidence of what follows from premises: that of the weakest, within 0 and 1; null without any."""
    return clamp01(F.array_min(premises))


def abstraction_clusters(claims: DataFrame, pairs: DataFrame, now: Column, settled_days: int = 14, least_similarity: float = 0.55, least_size: int = 3, most_depth: int = 1, stale: float = 0.5) -> DataFrame:
    """cluster (its smallest id), size, confidence, support of settled claims that are alike.

    claims(id, confidence, asserted_at, depth, anchored, stale), pairs(a, b, sim)
    of similar ones. A claim counts if it is old enough, no abstraction of
    abstractions and not anchored in time. confidence is that of the weakest
    premise, support the mean of all, stale ones counting less.
    """
    old = claims.where((age_days(F.col("asserted_at"), now) >= settled_days) & ~F.col("anchored") & (F.col("depth") <= most_depth - 1))
    ids = old.select("id")
    links = pairs.where(F.col("sim") >= least_similarity).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    rows = old.join(components(links.select("a", "b")).withColumnRenamed("node", "id"), "id")
    weight = F.when(F.col("stale"), stale).otherwise(1.0)
    out = rows.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("size"), clamp01(F.min("confidence")).alias("confidence"), (F.sum(F.col("confidence") * weight) / F.count("*")).alias("support"))
    return out.where(F.col("size") >= least_size)


def scheduled(probes: DataFrame, run: str, order: Sequence[Column], most: int) -> DataFrame:
    """probes with place and taken: the first ``most`` of each run by the given
    order are taken, the others told apart. A run's order is found in blocks, so
    that no task has a whole run."""
    dealt = probes.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(64)))
    local = dealt.withColumn("_nth", F.row_number().over(W.partitionBy(run, "_block").orderBy(*order, "id")))
    first = local.where(F.col("_nth") <= most).withColumn("place", F.row_number().over(W.partitionBy(run).orderBy(*order, "id")))
    first = first.withColumn("taken", F.col("place") <= most)
    rest = local.where(F.col("_nth") > most).withColumns({"place": F.lit(None).cast("int"), "taken": F.lit(False)})
    return first.unionByName(rest).withColumn("place", F.when(F.col("taken"), F.col("place"))).drop("_block", "_nth")


def with_precedence(claims: DataFrame, conflicts: DataFrame, penalty: float = 0.6) -> DataFrame:
    """claims(id, published_at, score) with rank_score: the score, lowered for the
    older one of a flagged pair (a, b); score and confidence stay."""
    dates = claims.select("id", "published_at")
    pairs = conflicts.join(dates.select(F.col("id").alias("a"), F.col("published_at").alias("at_a")), "a").join(dates.select(F.col("id").alias("b"), F.col("published_at").alias("at_b")), "b")
    older = pairs.select(F.when(F.col("at_a") < F.col("at_b"), F.col("a")).when(F.col("at_b") < F.col("at_a"), F.col("b")).alias("id")).where("id IS NOT NULL").distinct()
    rows = claims.join(older.withColumn("_older", F.lit(True)), "id", "left")
    return rows.withColumn("rank_score", F.when(F.col("_older"), F.col("score") * penalty).otherwise(F.col("score"))).drop("_older")


def mined_uses(beliefs: DataFrame, sessions: DataFrame, similar: DataFrame, prefilter: int = 200, calls: int = 50) -> DataFrame:
    """session_id, id, by of beliefs that sessions used: those whose key stands
    literally among a session's keys, and the most similar others that a judge is
    to be asked about (by = judge), at most ``calls`` a session out of its
    ``prefilter`` best. beliefs(id, key), sessions(session_id, key),
    similar(session_id, id, sim)."""
    literal = sessions.join(beliefs, "key").select("session_id", "id").distinct()
    order = W.partitionBy("session_id").orderBy(F.desc("sim"), "id")
    near = similar.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= prefilter).join(literal, ["session_id", "id"], "left_anti")
    asked = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= calls).select("session_id", "id")
    return literal.withColumn("by", F.lit("literal")).unionByName(asked.withColumn("by", F.lit("judge")))


#: Shapes of a date line, and how many lines that aren't blank are looked at.
DATE_LINES, FIRST_LINES = (r"^(?:#+\s*)?(\d{4}-\d{2}-\d{2})", r"^(?:#+\s*)?([A-Z][a-z]+ \d{1,2}, \d{4})$", r"^(?:#+\s*)?(\d{1,2} [A-Z][a-z]+ \d{4})$"), 5
_MONTHS = "January February March April May June July August September October November December".split()


def leading_date(text: Column) -> Column:
    """The date that one of the first lines of a text states, as DATE: 2024-05-01, May 1, 2024 or 1 May 2024."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, FIRST_LINES)
    month = lambda name: F.lpad(F.array_position(F.lit(_MONTHS), name).cast("string"), 2, "0")

    def date(line: Column) -> Column:
        iso = F.regexp_extract(line, DATE_LINES[0], 1)
        english, other = F.split(F.regexp_extract(line, DATE_LINES[1], 1), ",? "), F.split(F.regexp_extract(line, DATE_LINES[2], 1), " ")
        named = F.concat_ws("-", F.get(english, F.lit(2)), month(F.get(english, F.lit(0))), F.lpad(F.get(english, F.lit(1)), 2, "0"))
        turned = F.concat_ws("-", F.get(other, F.lit(2)), month(F.get(other, F.lit(1))), F.lpad(F.get(other, F.lit(0)), 2, "0"))
        return F.coalesce(iso.try_cast("date"), named.try_cast("date"), turned.try_cast("date"))

    return F.get(F.array_compact(F.transform(lines, date)), F.lit(0))


def deposit_date(explicit: Column, text: Column, modified: Column) -> Column:
    """When a deposit was written: as said, else as one of its first lines says, else when its file changed."""
    return F.coalesce(explicit, leading_date(text).cast("timestamp"), modified)


#: Keys of a clipped page's header in order of preference.
CLIPPED = {"url": ("source", "url", "link"), "author": ("author", "by"), "published": ("published", "date", "created"), "title": ("title",)}


def clipped(header: Column, keys: dict[str, Sequence[str]] | None = None) -> Column:
    """struct of what a clipped page's header (a map) says, each from its first key that is there."""
    return F.struct(*[F.coalesce(*[F.nullif(F.trim(F.try_element_at(header, F.lit(k))), F.lit("")) for k in names]).alias(name) for name, names in (keys or CLIPPED).items()])


#: Similarity from which subjects are one, and below which a link is suppressed or held back.
SAME_SUBJECT, SUPPRESS, ABSTAIN = 0.88, 0.25, 0.15


def subject_decision(similarity: Column, same: float = SAME_SUBJECT, suppress: float = SUPPRESS, abstain: float = ABSTAIN) -> Column:
    """What a similarity of two subjects says: duplicate, linked, suppressed or abstained."""
    if abstain > suppress:
        raise ValueError("abstaining has to start below suppressing")
    return F.when(similarity >= same, "duplicate").when(similarity >= suppress, "linked").when(similarity >= abstain, "suppressed").otherwise("abstained")


def subject_coverage(asked: DataFrame, subjects: DataFrame, claims: DataFrame, low: int = 3) -> DataFrame:
    """name, gap of asked(name): no_match, none, low or null, by how many claims its subject has.

    subjects(subject_id, name), claims(subject_id); names are compared in any case.
    """
    known = subjects.select("subject_id", F.lower(F.trim("name")).alias("_name"))
    counts = claims.groupBy("subject_id").agg(F.count("*").alias("n"))
    rows = asked.withColumn("_name", F.lower(F.trim("name"))).join(known, "_name", "left").join(counts, "subject_id", "left")
    best = rows.groupBy("name").agg(F.count("subject_id").alias("_m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.select("name", F.when(F.col("_m") == 0, "no_match").when(F.col("n") == 0, "none").when(F.col("n") < low, "low").alias("gap"))


def calibration_shares(claims: DataFrame, source: str) -> DataFrame:
    """source, n, fraction of each calibration source: counted first, so what meets is a handful of rows."""
    counts = claims.groupBy(source).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))


#: What a review says, and what then happens to either claim.
RESOLUTIONS = {"PREFER_A": ("ACTIVE", "SUPERSEDED"), "PREFER_B": ("SUPERSEDED", "ACTIVE"), "BOTH_VALID": ("ACTIVE", "ACTIVE"), "DEFER": (None, None)}


def resolved(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(id, status) with status after reviews(a, b, resolution, at): of several
    on one claim the last counts; deferred ones change nothing. Every review stays
    a row of its own; this only applies them."""
    sides = []
    for key, i in (("a", 0), ("b", 1)):
        to = F.coalesce(*[F.when(F.col("resolution") == r, F.lit(t[i])) for r, t in RESOLUTIONS.items() if t[i]])
        sides.append(reviews.select(F.col(key).alias("id"), "at", to.alias("to")).where("to IS NOT NULL"))
    last = sides[0].union(sides[1]).groupBy("id").agg(F.max(F.struct("at", "to")).alias("x"))
    return claims.join(last, "id", "left").withColumn("status", F.coalesce("x.to", "status")).drop("x")


#: Lenses with a default rule that an observer adopts at most: they travel with the plan.
MOST_DEFAULTS = 1000


def decay_rules(rules: DataFrame, source_type: str, url: str, claims: DataFrame) -> DataFrame:
    """claims with half_life and floor from rules(lens, scope, match, half_life, floor).

    Scopes are url_pattern, whose match is a regular expression that is sought
    in the address, and source_type. In a lens a rule for addresses beats one
    for the source type; across lenses the shortest half-life and the lowest
    floor count. Without a rule both are null.
    """
    return _ruled(rules.where("scope <> 'default'"), source_type, url, claims, ("half_life", "floor"))


def utility_rules(rules: DataFrame, source_type: str, url: str, claims: DataFrame) -> DataFrame:
    """claims with half_life and rate, as decay_rules; a lens may have a rule of scope default, which its others beat."""
    return _ruled(rules, source_type, url, claims, ("half_life", "rate"))


def _ruled(rules: DataFrame, source_type: str, url: str, claims: DataFrame, values: tuple[str, str]) -> DataFrame:
    """Rules for addresses and for source types are joined by address and by type, once for
    each pair of them; a default counts where its lens says nothing else."""
    cases = claims.select(F.col(source_type).alias("_type"), F.col(url).alias("_url")).distinct()
    told = rules.select("lens", "scope", "match", *values)
    by_url = told.where("scope = 'url_pattern'")
    sent = url_rules.spread(told)
    found = url_rules.matches(cases.select("_url"), by_url, "_url", "match").withColumnsRenamed({"url": "_url", "pattern": "match"})
    met = cases.join(found, "_url").join(sent(by_url), "match").select("_type", "_url", "lens", *values, F.lit(0).alias("rank"))
    by_type = told.where("scope = 'source_type'").select(F.col("match").alias("_type"), "lens", *values)
    met = met.unionByName(cases.join(sent(by_type), "_type").select("_type", "_url", "lens", *values, F.lit(1).alias("rank")))
    first = met.groupBy("_type", "_url", "lens").agg(F.min("rank").alias("best"))
    best = met.alias("m").join(first.alias("f"), F.col("m._type").eqNullSafe(F.col("f._type")) & F.col("m._url").eqNullSafe(F.col("f._url")) & (F.col("m.lens") == F.col("f.lens")) & (F.col("m.rank") == F.col("f.best"))).select("m.*")
    out = best.groupBy("_type", "_url").agg(*[F.min(v).alias(v) for v in values], F.collect_set("lens").alias("_lenses"))
    defaults = told.where("scope = 'default'").groupBy("lens").agg(*[F.min(v).alias(v) for v in values]).limit(MOST_DEFAULTS + 1).collect()
    if len(defaults) > MOST_DEFAULTS:
        raise ValueError(f"more than {MOST_DEFAULTS} lenses with a default rule")
    same = F.col(f"c.{source_type}").eqNullSafe(F.col("o._type")) & F.col(f"c.{url}").eqNullSafe(F.col("o._url"))
    silent = F.array(*[F.struct(F.lit(r["lens"]).alias("lens"), *[F.lit(r[v]).cast("double").alias(v) for v in values]) for r in defaults]) if defaults else None
    lowest = lambda v: F.col(f"o.{v}") if silent is None else F.least(F.col(f"o.{v}"), F.array_min(F.transform(F.filter(silent, lambda d: ~F.coalesce(F.array_contains(F.col("o._lenses"), d["lens"]), F.lit(False))), lambda d: d[v])))
    return claims.alias("c").join(out.alias("o"), same, "left").select("c.*", *[lowest(v).alias(v) for v in values])


def suggested_merges(pairs: DataFrame, verdicts: DataFrame, linked: DataFrame, least: float = 0.92, most: int = 50) -> DataFrame:
    """cluster, size, a, b, sim, verdict of pairs(a, b, sim) that may be one claim.

    Pairs already linked(a, b) are left out; a cluster keeps its ``most`` most
    similar pairs. verdicts(a, b, verdict) are a judge's, null where none was given.
    """
    near = pairs.where(F.col("sim") >= least).join(linked.select("a", "b").distinct(), ["a", "b"], "left_anti")
    groups = components(near.select("a", "b")).withColumnRenamed("node", "a")
    rows = near.join(groups, "a").withColumnRenamed("root", "cluster")
    sizes = groups.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("size"))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("sim"), "a", "b"))).where(F.col("_n") <= most).drop("_n")
    return first.join(sizes, "cluster").join(verdicts, ["a", "b"], "left").select("cluster", "size", "a", "b", "sim", "verdict")


#: Ends of the search for a temperature, and how near to them it counts as there.
COLDEST, HOTTEST, AT_END = 0.01, 10.0, 1e-3


def fit_diagnostics(rows: DataFrame, raw: str, correct: str, temperature: float, error_before: float, error_after: float, epsilon: float = 1e-7) -> DataFrame:
    """One row: n, n_fitted, n_saturated, distinct_raw, positive_rate, and what makes
    the fit not worth trusting: degenerate_labels, hit_bound, predictor_degenerate,
    non_improving, trustworthy."""
    inner = ~((F.col(raw) <= epsilon) | (F.col(raw) >= 1 - epsilon))
    out = rows.agg(F.count("*").alias("n"), F.count_if(inner).alias("n_fitted"), F.count_distinct(F.when(inner, F.col(raw))).alias("distinct_raw"), F.coalesce(F.avg(F.when(inner, F.col(correct).cast("double"))), F.lit(0.0)).alias("positive_rate"))
    out = out.withColumn("n_saturated", F.col("n") - F.col("n_fitted")).withColumn("degenerate_labels", (F.col("n_fitted") > 0) & F.col("positive_rate").isin(0.0, 1.0))
    out = out.withColumn("hit_bound", F.lit(temperature <= COLDEST + AT_END or temperature >= HOTTEST - AT_END)).withColumn("predictor_degenerate", F.col("distinct_raw") < 2).withColumn("non_improving", F.lit(error_after >= error_before))
    return out.withColumn("trustworthy", ~(F.col("degenerate_labels") | F.col("hit_bound") | F.col("predictor_degenerate") | F.col("non_improving")))
