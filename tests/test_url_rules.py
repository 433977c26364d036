from __future__ import annotations

import re

from factloom.operators import passes, policy, url_rules


def urls(spark, some):
    return spark.createDataFrame([(u,) for u in some], "url string")


def patterns(spark, some):
    return spark.createDataFrame([(p,) for p in some], "pattern string")


def test_literals_are_in_every_match():
    assert url_rules.literals(r"^https?://(www\.)?abc\.example/x+y") == ["http", "://", "abc.example/", "x", "y"]
    assert url_rules.literals("(ab|cd)ef(gh)ij$") == ["efghij"] and url_rules.literals("(?i)abcd") == [] and url_rules.literals("(unclosed") is None and url_rules.literals("a|bcde") == [] and url_rules.literals("(?:abc){2}d?") == ["abc"]
    assert url_rules.literals("(?=abcd)x(?!efgh)y") == ["x", "y"] and url_rules.literals("") == []


def test_against_every_pair(spark):
    some = ["https://a.example/sponsored/1", "http://b.example/x", "https://c.org/r/Python/2?x=1", "ftp://c.org", "", "abc", None, "https://a.example/sponsored/1", "http://é.example/日本語/x", "x" * 3000 + "needle"]
    rules = ["/sponsored/", "^https?://", r"/r/(?:Python|rust)/", "(?i)PYTHON", "[0-9]$", "", "a.*b", r"\.example/[a-z]$", "(unclosed", None, "日本", "日本語/", "needle$", "(?=https)", "^$", "nowhere to be found"]
    got = sorted(map(tuple, url_rules.matches(urls(spark, some), patterns(spark, rules)).collect()))
    valid = [r for r in rules if r is not None and r != "(unclosed"]
    assert got == sorted({(u, r) for u in some if u is not None for r in valid if re.search(r, u)})
    assert url_rules.matches(urls(spark, some).limit(0), patterns(spark, rules)).collect() == []


def test_many_rules_without_a_nested_loop(spark):
    """100,000 rules, each of which matches few addresses; all share their first literals."""
    rules = spark.range(100_000).selectExpr("concat('^https?://site', id, '[.]example/(a|b)') AS pattern")
    some = spark.range(3000).selectExpr("concat('https://site', id * 7, '.example/', CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END) AS url")
    found = url_rules.matches(some, rules)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 2000


def test_trust_by_rules(spark):
    claims = spark.createDataFrame([("d", "s", "h", "http://h/sponsored/1"), ("d", "s", "g", "http://g/sponsored/"), ("e", "s", "g", None), ("e", "s", None, "http://k")], "domain string, source_type string, host string, url string")
    statements = spark.createDataFrame([("d", "s", 0.5)], "domain string, source_type string, trust_rank double")
    rules = [("a", "domain", "h", 0.75, None), ("a", "url_pattern", "/sponsored/", None, -0.25), ("a", "url_pattern", "[0-9]$", None, -0.125), ("b", "url_pattern", "/sponsored/", None, 0.5), ("b", "url_pattern", "://k", None, 0.5)]
    got = policy.with_trust(claims, statements, spark.createDataFrame(rules, "lens string, scope string, pattern string, score double, modifier double"), "url")
    assert sorted((r.domain, str(r.host), r.trust) for r in got.collect()) == [("d", "g", 0.25), ("d", "h", 0.375), ("e", "None", 1.0), ("e", "g", 1.0)]


def test_rules_of_lenses(spark):
    rules = [("a", "default", None, 50.0, 0.5), ("a", "source_type", "s", 90.0, 0.9), ("a", "url_pattern", "x/[0-9]", 70.0, 0.7), ("b", "source_type", "s", 60.0, 0.8)]
    told = spark.createDataFrame(rules, "lens string, scope string, match string, half_life double, floor double")
    claims = spark.createDataFrame([(1, "s", "x/1"), (2, "s", None), (3, "t", "x/y"), (4, None, "x/2"), (5, "t", None)], "id long, kind string, url string")
    assert sorted((r.id, r.half_life, r.floor) for r in passes.decay_rules(told, "kind", "url", claims).collect()) == [(1, 60.0, 0.7), (2, 60.0, 0.8), (3, None, None), (4, 70.0, 0.7), (5, None, None)]
    use = passes.utility_rules(told.withColumnRenamed("floor", "rate"), "kind", "url", claims)
    assert sorted((r.id, r.half_life, r.rate) for r in use.collect()) == [(1, 60.0, 0.7), (2, 60.0, 0.8), (3, 50.0, 0.5), (4, 70.0, 0.7), (5, 50.0, 0.5)]


def test_rules_go_to_the_addresses(spark):
    """Few expressions and source types are no few tasks: nothing is dealt by them."""
    import __spark_entry__

    for name in ("decay_by_lens", "utility_by_lens"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for key in ("match", "_type", "run", "salt"):
            assert not re.search(rf"(SortMergeJoin|ShuffledHashJoin) \[{key}#\d+\]", plan), key
