"""Parsing, rules and alias propagation against SQL and by hand."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from assayer.llm import urls

CANON = '<html><LINK data-x="1" href="{}" rel="canonical"><p>'
FRESH = "<meta content='0; url={}' http-equiv='Refresh'/>"
ROWS = [
    (1, "https://a.example.org/x", CANON.format("http://spam.net/y")),          # target blocked, not a page
    (2, "http://b.org/1", FRESH.format("https://A.example.org/x#top")),          # through page 1
    (3, "http://c.org/fr/z", CANON.format("http://b.org/1")),                    # explicit allow stays
    (4, "http://d.org/p/q?x=1", CANON.format("r")),                              # relative, alone
    (5, "http://d.org/p/r", None),
    (6, "http://e.org", FRESH.format("//c.org/fr/z")),                           # through an allowed page
    (7, "http://e.org/", "<link rel=stylesheet href='http://spam.net/y'>"),      # no alias
    (8, None, CANON.format("http://spam.net/y")),
    (9, "no scheme net/", CANON.format("http://spam.net/y")),
    (10, "http://www.Example.NET/en/1?q=://x", ""), (11, "http://net", ""), (12, "http://net/", ""),
    (13, "x://sub.example.com/de/", ""), (14, "x://example.com.evil/de/", ""), (15, "http://notexample.com/de/", ""),
    (16, "https://f.org?x#y", CANON.format("/root")), (17, "http://f.org/root", FRESH.format("http://g.net/")),
    (None, "http://g.net/", None), (2, "http://b.org/1", None), (18, "", ""), (19, "http:///p", ""),
    (20, "http://h.org/a b\nc?d", CANON.format("http://h.org/self") + CANON.format("http://spam.net/y")),
]


def test_against_sql_and_by_hand(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("verdict", F.lit("x"))
    out = urls.judge(pages).collect()
    frame = pd.DataFrame(ROWS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", frame)
    res = con.execute(urls.SQL)
    names = [d[0] for d in res.description]
    want = sorted(map(repr, (tuple(r) for r in con.execute(urls.SQL).fetchall())))
    assert sorted(repr(tuple(r[n] for n in names)) for r in out) == want
    verdict = {r.page_id: (r.verdict, r.decided_by) for r in out}
    assert verdict[1] == verdict[2] == verdict[6] == verdict[16] == verdict[17] == ("block", "alias")
    assert verdict[3] == verdict[10] == ("allow", "rule") and verdict[12] == ("block", "rule")
    assert verdict[4] == verdict[5] == verdict[7] == verdict[8] == verdict[9] == verdict[11] == ("allow", "default")
    assert len(out) == len(ROWS) and urls.judge(pages.limit(0)).count() == 0


def test_redirect_table_and_no_rules(spark):
    pages = spark.createDataFrame([(i, f"http://p{i}.org/", "") for i in range(6)], "page_id long, url string, html string")
    hops = spark.createDataFrame([(f"http://p{i}.org/", f"http://p{i + 1}.org/") for i in range(4)] + [(None, "http://p5.org/")],
                                 "source string, target string")
    rules = [urls.Rule("p4.org", "/", "block"), urls.Rule("p2.org", "/", "allow")]
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules, hops).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}
    assert {r.verdict for r in urls.judge(pages, [], hops).collect()} == {"allow"}


def test_query(spark, data):
    assert check.compare(spark, check.connect(data), data, "op2_url_equivalence",
                         entry.oracle_sql()["op2_url_equivalence"]).startswith("ok")
