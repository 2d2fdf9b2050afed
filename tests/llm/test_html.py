import html
import random
import re
import time

from pyspark.sql import functions as F

from keyroll.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy now.</div>%s
<aside><p>See also other things here.</p></aside><form><label>Name</label><input></form>
<section id="comments"><p>First comment by a reader, long enough.</p></section><footer>&copy; us</footer></body></html>"""
BODY = "<article><h1>Title &amp; more</h1><p>One <b>bold</b>word,\n  two&nbsp;three.</p><p>Caf&eacute; &#8364;5<br>next <!-- no --> line</article>"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")


def test_marked_and_unmarked_pages(spark):
    text = "Title & more One boldword, two three. Café €5 next line"
    plain = BODY.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    frame = pages(spark, [PAGE % BODY] * 5 + [PAGE % plain])
    scores = hx.learn(frame)
    got = [r["text"] for r in hx.main_text(frame, scores).orderBy("row.page_id").collect()]
    assert got == [text] * 6
    for t in hx.tokens(PAGE % BODY):
        if t.name or t.words:
            assert scores[t.kind] < 0 if t.name else scores[t.kind] > 0


def test_best_run_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.choice((-3, -1, 0, 1, 2)) for _ in range(rng.randint(0, 12))]
        start, end = hx.best_run(v)
        best = max((sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=0)
        assert sum(v[start:end]) == max(best, 0)


def test_broken_pages(spark):
    rows = [None, "", "plain text only", "<p>a<p>b", "<script>never closed", "<!-- never closed", "<i title='x>y'>z</i> w",
            "<div hidden>no</div>yes", "<ul class=menu><li>x</ul>text", "a &lt;b&gt; &amp;amp; c", "<p>" + "word " * 50_000 + "</p>",
            "<article>" * 500 + "deep words", "< 5 and > 3", "<p>x</p></div></div><p>y</p>"]
    got = [r["text"] for r in hx.main_text(pages(spark, rows), {}).orderBy("row.page_id").collect()]
    assert got[:3] == ["", "", "plain text only"] and got[4:6] == ["", ""] and got[6] == "z w" and got[7] == "yes"
    assert got[8] == "text" and got[9] == "a <b> &amp; c" and len(got[10]) == 249_999 and got[11] == "deep words"


def test_empty_table_and_clashing_names(spark):
    none = pages(spark, [])
    assert hx.learn(none) == {} and hx.main_text(none, {}).count() == 0
    odd = pages(spark, ["<p>words here</p>"] * 2).withColumn("text", F.lit(1)).withColumn("row", F.lit("r"))
    assert [(r["text"], r["row"]["text"]) for r in hx.main_text(odd, {}).collect()] == [("words here", 1)] * 2


def wanted(source):
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?[ab]>", "", body))).split())


def unnamed(source):
    """Boilerplate without telling names: its elements are divs, no class, id or role is left."""
    plain = re.sub(r"<(/?)(?:nav|aside|footer|header|form)\b", r"<\1div", source)
    return re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", plain)


def test_whole_test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in hx.main_text(frame.withColumn("source", F.col("html")), hx.learn(frame)).collect():
        assert r["text"] == wanted(r["row"]["source"])


def test_boilerplate_without_names_is_found_by_the_scan(spark):
    """Of pages whose boilerplate no list knows, and of the same without the mark, the
    region is right; without the scan none is."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    plain = pages(spark, [unnamed(h) for h in rows])
    scores = hx.learn(plain)
    want = [wanted(h) for h in rows]
    got = [r["text"] for r in hx.main_text(plain, scores).orderBy("row.page_id").collect()]
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(rows)
    unmarked = [hx.extract(re.sub(r"<(/?)article\b", r"<\1div", unnamed(h)), scores) for h in rows]
    assert sum(a == b for a, b in zip(unmarked, want)) >= 0.9 * len(rows)
    assert not any(hx.text_of(list(hx.tokens(unnamed(h)))) == w for h, w in zip(rows, want))


def test_hostile_pages_take_linear_time():
    n = 90_000
    for page in ("<div>" * n + "</x>" * n, "<div>" * n + "</div>" * n, "<!x" * n, "<a '" * n, "<a \"" * n + "'" * n, "<p><b>" * n):
        start = time.process_time()
        hx.extract(page, {})
        assert time.process_time() - start < 4
