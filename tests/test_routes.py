from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import catalogues, chunks, documents, extract, graph_claims, replies


def test_every_route_has_an_extractor(spark):
    names = [n for n, _ in extract.ROUTES[:-1]] + ["SOMETHING_ELSE"]
    got = {r.n: r.r for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", extract.route(F.col("n")).alias("r")).collect()}
    assert all(r.built for r in got.values()) and got["SOMETHING_ELSE"].extractor == "GENERAL"
    modules = {"catalogues": catalogues, "chunks": chunks, "documents": documents, "extract": extract, "graph_claims": graph_claims, "replies": replies}
    for ways in extract.BUILT.values():
        for way in ways.split(", "):
            module, _, name = way.rpartition(".")
            assert hasattr(modules[module], name) if module else way == "replies" or any(hasattr(m, way) for m in modules.values()), way
