"""Boilerplate lines against counting by hand."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lumenprep.llm.line_dedup import drop_boilerplate, host_of, html_lines


def brute(rows, ratio=0.3, least=5):
    pages, seen = Counter(r[1] for r in rows), Counter()
    for _, host, text in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} if text is not None else ():
            seen[host, line] += 1
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None))
            continue
        drop = lambda x: pages[host] >= least and x.strip(" ") and seen[host, x.strip(" ")] >= 2 and seen[host, x.strip(" ")] > ratio * pages[host]
        out.append((i, "\n".join(x for x in text.split("\n") if not drop(x))))
    return sorted(out, key=str)


ROWS = (
    [(i, "big", f"nav\n menu \nline {i}\n\nline {i}\nshared {i % 4}\nfoot") for i in range(400)]
    + [(1000 + i, "small", f"nav\nown {i}") for i in range(4)]
    + [(2000 + i, None, "nav\nnav\nx" if i % 3 else f"solo {i}") for i in range(9)]
    + [(3000, "big", None), (3001, "big", ""), (3002, "long", "w " * 50_000), (3003, "long", "a\n" * 5000)]
    + [(4000, "same", "all\nlines\ngo")] * 12
)


def test_equals_counting(spark):
    docs = spark.createDataFrame([(a, b, c, "clash", 7) for a, b, c in ROWS], "doc_id bigint, host string, text string, lines string, n_chars int")
    out = drop_boilerplate(docs, F.col("host"), F.col("text"), "text")
    assert out.columns == [*docs.columns, "lines_dropped"]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == brute(ROWS)
    assert {r.lines for r in out.collect()} == {"clash"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, host string, text string")
    assert drop_boilerplate(docs, F.col("host"), F.col("text"), "text").count() == 0


def test_hosts_and_html(spark):
    url = {"http://A.b.com:80/x": "a.b.com", "https://u:p@h.org?q": "h.org", "nothing": None, None: None, "https://h.net#f": "h.net"}
    got = spark.createDataFrame([(u,) for u in url], "u string").select("u", host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == url
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><ul><li><a href=x>one</a></li><li>two</li></ul><!-- no --><p><b>bold</b> text<br>next</body></html>"
    assert spark.range(1).select(html_lines(F.lit(page)).alias("t")).first().t == "T\none\ntwo\nbold text\nnext"
