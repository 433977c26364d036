"""Rules whose pattern is a regular expression, met with many addresses.

No address meets a rule that can't match it: a text that an expression matches
holds its literal parts. Each rule is known by one run of four characters of its
literals, the one that the fewest addresses hold; addresses are joined by their
runs, and only these pairs are searched. Rules without a literal meet all
addresses, dealt over SALT parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.shared import bounded_batches

#: Characters of a run, and parts in which rules without a literal meet the addresses.
RUN, SALT = 4, 32
#: Rules up to which they go to every task: a run, an expression or a source type may be that of most addresses.
MOST_BROADCAST = 100_000


def spread(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A broadcast of what has at most a row for each of these rules and what it matches, if they are few enough."""
    return F.broadcast if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df


def literals(pattern: str) -> list[str] | None:
    """Texts of which a match holds every one; null for what isn't an expression."""
    try:
        tree = sre_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return []
    out, held = [], []

    def walk(items: sre_parser.SubPattern) -> None:
        for op, value in items:
            if op is sre.LITERAL:
                held.append(chr(value))
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op is not sre.AT:  # anchors have no width
                out.append("".join(held))
                held.clear()
                if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                    walk(value[2])
                    out.append("".join(held))
                    held.clear()

    walk(tree)
    return [x for x in [*out, "".join(held)] if x]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        patterns = b.column("pattern").to_pylist()
        told = [None if p is None else literals(p) for p in patterns]
        runs = [None if t is None else sorted({x[i : i + RUN] for x in t for i in range(len(x) - RUN + 1)}) for t in told]
        yield pa.RecordBatch.from_arrays([b.column("pattern"), pa.array(runs, pa.list_(pa.string()))], names=["pattern", "runs"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled: dict[str, re.Pattern] = {}
    for b in batches:
        keep = []
        for url, pattern in zip(b.column("url").to_pylist(), b.column("pattern").to_pylist(), strict=True):
            if pattern not in compiled:
                if len(compiled) >= 10_000:
                    compiled.clear()
                compiled[pattern] = re.compile(pattern)
            keep.append(compiled[pattern].search(url) is not None)
        yield b.filter(pa.array(keep, pa.bool_()))


def matches(urls: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """url, pattern of every address in which an expression is found, each pair once.

    Null addresses match nothing, and neither does what isn't an expression.
    """
    bounded_batches(urls.sparkSession)
    addresses = urls.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    rules = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct().mapInArrow(_runs, "pattern string, runs array<string>").where("runs IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.length("url") - RUN + 1, F.lit(1)))
    held = addresses.select("url", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("url"), i, F.lit(RUN))))).alias("run"))
    counts = held.groupBy("run").agg(F.count("*").alias("n"))
    each = rules.where(F.size("runs") > 0).select("pattern", F.explode("runs").alias("run"))
    # a run that no address holds: the rule matches none
    rarest = each.join(counts, "run", "left").groupBy("pattern").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("run"))).alias("run"))
    sent = spread(patterns)
    by_run = held.join(sent(rarest), "run").select("url", "pattern")
    anything = rules.where(F.size("runs") == 0).select("pattern", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    by_part = addresses.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALT)).cast("int")).join(sent(anything), "salt").select("url", "pattern")
    return by_run.unionByName(by_part).mapInArrow(_search, "url string, pattern string")
