from lodestone.llm import url_filter
from lodestone.llm.components import connected_components


def run(spark, rows, rules=url_filter.RULES):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head>'


ROWS = [
    (1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "http://example.net/de", ""), (3, "https://b.org/fr/1", None), (4, None, "x"), (5, "nonsense", None), (6, "http://x.net", None),
    (7, "http://free.org/a", link("http://www.example.com/de/1")), (8, "http://free.org/b", '<meta http-equiv="refresh" content="0; url=/a">'), (9, "http://c.org/1", link("http://c.org/fr/1")),
    (10, "http://notexample.com/de/", None), (11, "http://free.org/b#top", None), (12, "http://q.example.net?x=/en/", None), (13, "x://y.example.com/de/://z", None),
]


def test_rules_and_aliases(spark):
    got = run(spark, ROWS)
    want = {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "allow"), 13: ("example.com/de/", "block")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/x") and (got[4].host, got[5].path) == ("", "") and got[6].path == ""


def test_joined_rules_equal_inline(spark, monkeypatch):
    a = {k: (r.rule, r.verdict) for k, r in run(spark, ROWS).items()}
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert {k: (r.rule, r.verdict) for k, r in run(spark, ROWS).items()} == a


def test_empty(spark):
    assert run(spark, []) == {}


def test_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.execute(url_filter.ORACLE).fetchall())
    assert sorted(tuple(r) for r in url_filter.query(spark, sf).collect()) == want


def test_components(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
