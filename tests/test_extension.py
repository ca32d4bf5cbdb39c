"""Rules under SQL names, and links as an independent parser reads them."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from crawlgrain.functions import content, sql, urls


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v or "" for k, v in attrs if k == "href"][:1]


def read(html):
    r = Reader()
    r.feed(html)
    r.close()
    return r.found


VECTORS = {
    "<a href=x.html>": ["x.html"],
    "<A\nHREF = 'a&amp;b'>": ["a&b"],
    '<a title="href=no" href="y?a=1&amp;b=2">': ["y?a=1&b=2"],
    "<!-- <a href=c> --><a href=d>": ["d"],
    "<!-->x<a href=t><!--<a href=u>": ["t"],
    "<script>'<a href=e>'</script><a href=f>": ["f"],
    "<textarea><a href=no></textarea><style><a href=no></style ><title><a href=no></title><a href=p>": ["p"],
    '<a href="g"href="h">': ["g"],
    "<a data-href=no><abbr href=no></a href=no>< a href=no>": [],
    "<a href><a href= >": ["", ""],
    "<a/href=j/k><a href=l\"m>": ["j/k", 'l"m'],
    "<a x=1 y = \"2>3\" z='<' href=q>": ["q"],
    '<a title="open <a href=z>': [],
    "<a href=s": [],
    '<a href="&#x41;&#66;&copy;&nothing;&copy=1&amp">': ["AB©&nothing;&copy=1&"],
    '<a href="&#128;&#0;&#xD800;&#x1F600;&#65279;&#99999999999;x">': ["€��\U0001f600﻿�x"],
    "<!doctype html><?pi <a?><a href=n>": ["n"],
    "": [],
}


def test_links_in_every_state_of_a_page(spark):
    rows = spark.createDataFrame([(t,) for t in VECTORS] + [(None,)], "t string").select("t", content.hrefs(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == VECTORS | {None: None}


def test_links_equal_an_independent_parser(spark):
    random.seed(20)
    bits = ["<a ", "<a\t", "<A ", "href=", "HREF = ", "href='v w'", 'href="v>&amp;w"', "x.html", "/p?a=1&amp;b=2", "title='<a href=no>'", " ", ">", "</a>", "<!--", "-->", "<script>", "</script>", "<b title=", "data-x=1 ", "text", "&#65;", "/", "<p>", "&eacute;"]
    pages = ["".join(random.choices(bits, k=random.randint(1, 30))) for _ in range(600)] + ["<a " + "x=1 " * 30000 + "href=long>", "<!--" + "<a href=no> " * 30000 + "--><a href=r>"]
    # whatever is unfinished ends a page for a browser, while that parser goes on: so tag, comment and script are closed here
    pages = [p + " x>" + "-->" + "</script>" for p in pages]
    got = {r["i"]: r["h"] for r in spark.createDataFrame(list(enumerate(pages)), "i int, t string").select("i", content.hrefs(F.col("t")).alias("h")).collect()}
    whole = [i for i, p in enumerate(pages) if p.count("<!--") <= 1 and p.count("<script>") <= 1 and "<!-->" not in p]
    assert len(whole) > 300
    for i in whole:
        assert got[i] == read(pages[i]), pages[i][:300]


def test_rules_under_sql_names(spark, sf):
    names = sql.register(spark)
    assert set(sql.register(spark)) == set(names)
    known = {r["function"].rpartition(".")[2] for r in spark.sql("show user functions like 'crawl*'").collect()}
    assert set(names) <= known
    spark.read.parquet(sf + "/pages.parquet").createOrReplaceTempView("pages_for_sql")
    here = spark.table("pages_for_sql").select("page_id", urls.canonical_url(F.col("url")).alias("c")).collect()
    there = spark.sql("select page_id, crawl_canonical_url(url) as c from pages_for_sql")
    assert sorted(here) == sorted(there.collect()) and "Python" not in there._jdf.queryExecution().toString()
    row = spark.sql("""select crawl_canonical_url('HTTP://User@Ex.com:80/A//?b=2&a=1%20~*') as a, crawl_outcome(503, false, 3, 2) as b, crawl_usable_ipv4('127.0.0.1') as c,
      crawl_kept_headers(map('Server', 's', 'X', 'y')) as d, crawl_hrefs('<a href=x>') as e, crawl_bounded_int(' 7 ') as f, crawl_signal_weight('http_429') as g""").first()
    assert tuple(row) == ("http://ex.com/A?a=1+~%2A&b=2", "retry_exhausted", False, {"server": "s"}, ["x"], 7, 3)


def test_links_as_a_table_function(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "<a href=../b?q=1&amp;r=2>x</a><!-- <a href=no> --><a href='//CDN.example.org/y'><a href=mailto:a@b>", "https://Example.com/d/e/f"), (2, None, None), (3, "<a href='http://[bad'>", "x")], "id int, html string, url string").createOrReplaceTempView("few")
    got = spark.sql("select id, l.* from few, lateral crawl_outlinks(html, url) l order by id, pos").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "../b?q=1&r=2", "https://example.com/d/b?q=1&r=2".replace("example", "Example"), "example.com", False),
        (1, 1, "//CDN.example.org/y", "https://CDN.example.org/y", "cdn.example.org", True),
        (1, 2, "mailto:a@b", "mailto:a@b", None, None),
        (3, 0, "http://[bad", None, None, None),
    ]


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_every_function_takes_nulls(spark, name):
    sql.register(spark) if name == min(sql.FUNCTIONS) else None
    n = sql.FUNCTIONS[name][0].count(",") + 1 - sql.FUNCTIONS[name][0].count("<string,string>")
    spark.sql(f"select {name}({', '.join(['null'] * n)}) as x").collect()
