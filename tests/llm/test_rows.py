"""Ops 2, 5, 8 and 9: against SQL or brute force, and odd rows."""

from __future__ import annotations

import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import html_extract, mixing, quality, topk
from ledgerframe.llm.html_extract import Paths, extract, parse
from ledgerframe.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    assert same(QUERIES[name](spark, data), ORACLE_SQL[name], data) > 0


def test_quality_counts(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_rules(docs).collect():
        t = rows[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + d for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[k] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    got = quality.quality_rules(odd).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 50)
    assert quality.quality_rules(odd.limit(0)).collect() == []
    plan = quality.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k_ties_and_odd_vectors(spark):
    e = [(0, [1.0, 0.5]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-1.0, -1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(e, "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    v = {i: [int(256 * x) for x in x] for i, x in e[:4] + e[7:8]}
    want = []
    for q in (0, 50):
        s = sorted(((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q))[:5]
        want += [(q, k, i, -n) for k, (n, i) in enumerate(s, 1)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_many_cells(spark, data, monkeypatch):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    want = sorted(topk.top_k(df).collect())
    for name, value in (("CANDIDATES", 60), ("QUERIES", 1), ("PIVOTS", 5), ("SAMPLE", 20)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(topk.top_k(df).collect()) == want


def test_top_k_tells_rows_apart(spark):
    """Rows with one id are queries and candidates each, equal rows as often as they occur; large components count."""
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [-1.0, 2.0]), (50, [0.0, 1.0]), (1, [3e12, 1.0]), (2, [-3e12, 1.0]), (2, [-3e12, 1.0]), (3, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("i", F.lit(0))
    v = [(i, [int(256 * x) for x in x]) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(v):
        if q % 50 == 0:
            s = sorted((-sum(m * n for m, n in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(v) if a != b)[:5]
            want += [(q, k, i, -n) for k, (n, i) in enumerate(s, 1)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError|too large|too big"):
        topk.top_k(huge).collect()


def test_articles(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        a = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        a = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", a))
        assert r.text == " ".join(html.unescape(a).split()) and r.n_chars == len(r.text)


def test_pages_without_marks_and_odd_ones(spark):
    page = "<html><body><div class=top><a>Home</a> <a>About</a></div><div class=body><p>{0} first words here</p><p>more &amp; more of {0}</p></div><div class=end>All rights</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"story{i}")) for i in range(8)]
    rows += [(100, None, None), (101, "http://x.example/", ""), (102, "nonsense", "<p>un<b>closed <div>text"), (103, "http://y.example/", "<script>if (a < b) x()</script>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story3 first words here more & more of story3"
    assert (got[100], got[101], got[102], got[103]) == ("", "", "unclosed text", "")
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    mixed = "<article><header><h1>T</h1></header><p>a<i>b</i> c</p><aside>no</aside><div id='comments'><p>no</p></div><p>d<br>e</p></article>"
    paths = Paths()
    assert [b.text for b in parse(mixed, paths).blocks if not b.unwanted and not paths.named[paths.parent[b.path]]] == ["T", "ab c", "d", "e"]


def test_pages_without_marking_tags(spark):
    """The template decides, not the tags: plain divs, or such with classes that say nothing, give the same texts, where a host
    has pages enough."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 400").withColumn("url", F.concat(F.lit("http://h.example/"), "page_id"))
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(article|main)\\b", "<div"), "</(article|main|nav|aside|footer)>", "</div>"))
    for k, tag in enumerate(("nav", "aside", "footer", 'div class="ad"')):
        plain = plain.withColumn("html", F.replace("html", F.lit(f"<{tag}>"), F.lit(f"<div class=q{k}>")))
    assert plain.where("html rlike '<(article|nav|aside|footer)'").count() == 0
    want = {r.page_id: r.text for r in extract(pages).collect()}
    got = {r.page_id: r.text for r in extract(plain).collect()}
    assert sum(want[k] == got[k] for k in want) >= 0.99 * len(want)


def test_names_in_articles_and_depth(spark):
    page = "<html><body><div class=menu><a>Home</a> <a>About</a></div><div class=story><h1>On {0}</h1><p>{0} first words of some length here</p>{1}<div class=comments><p>reader {0} says no</p></div></div><div>All rights</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"tale{i}", '<div class="related-work"><p>earlier work counts <label>too</label></p></div>' if i == 3 else "")) for i in range(8)]
    deep = "<div>" * 100_000 + "deep text" + "</span>" * 1000 + "</div>" * 100_000
    rows += [(100, "http://deep.example/", deep), (101, "http://deep.example/b", deep), (200, "http://one.example/", "<main>only <b>page</b></main><div class=ad>buy</div>")]
    rows += [(300, "http://twice.example/", page.format("same", ""))] * 70
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("part", F.lit("x"))
    got = extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "On tale3 tale3 first words of some length here earlier work counts too"
    assert text[5] == "On tale5 tale5 first words of some length here"
    assert text[100] == text[101] == "deep text" and text[200] == "only page"
    assert len({r.text for r in got if r.page_id == 300}) == 1 and "same first words of some length here" in text[300]


def test_template_blocks_inside_articles(spark):
    """A box that the host repeats goes, named or not; of near copies, or of too few pages, nothing does."""
    page = "<html><body><article><h1>About {0}</h1><p>{0} first words of some length here</p><div><b>Read us daily</b></div><p>more on {0} and {0} again</p><p>Written by us</p></article></body></html>"
    copy = "<html><body><article><h1>Same title</h1><p>The same long story on every page</p><p>seen {0}</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"story{i}")) for i in range(8)]
    rows += [(20 + i, f"http://near.example/{i}", copy.format(i)) for i in range(8)]
    rows += [(40 + i, f"http://few.example/{i}", page.format(f"story{i}")) for i in range(3)]
    rows += [(60 + i, f"http://same.example/{i}", page.format("one").replace("<article>", f"<div>ad {i}</div><article>")) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "About story3 story3 first words of some length here more on story3 and story3 again"
    assert got[23] == "Same title The same long story on every page seen 3"
    assert got[41] == "About story1 story1 first words of some length here Read us daily more on story1 and story1 again Written by us"
    assert got[62] == got[41].replace("story1", "one")


def test_groups_of_a_host_depend_on_no_other(spark, monkeypatch):
    """One host has most pages, and there are many small hosts: each of those is one group; joined either way."""
    page = "<html><body><div class=top><a>Home</a> <a>About</a></div><div class=body><p>{0} first words here</p><p>more of {0}</p></div><div class=end>All rights</div></body></html>"
    hosts = ["hot.example"] * 3000 + [f"h{i % 40}.example" for i in range(400)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", page.format(f"story{i}")) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "TABLE", 1, raising=False)  # of the former table of counts by hash: all in one row
    for few in (1 << 17, 0):
        monkeypatch.setattr(html_extract, "FEW", few, raising=False)
        got = extract(df).collect()
        assert len(got) == len(hosts) and all(r.text == f"story{r.page_id} first words here more of story{r.page_id}" for r in got)


def test_mix(spark, odd, make):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(odd.limit(0)).collect() == []
    docs = make(*((i, "w " * (i % 7 + 1), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(600)))
    rows = mixing.mix_sources(docs).collect()
    by, target = Counter(), {}
    for r in rows:  # sources of equal weight have equal targets: told apart by the documents
        source = f"s{r.doc_id % 5}" if r.doc_id % 3 else "hot"
        by[source] += r.taken
        target[source] = r.target
    assert len(target) == 6 and all(abs(by[k] - t) <= 7 for k, t in target.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_targets_stop_at_three_times(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1000), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["a"] == 3 and got[None] == 30 and abs(got["b"] - 978) < 1e-9
