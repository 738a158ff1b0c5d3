"""Pages: URL rules and trees, main text, archives."""

import base64
import hashlib
import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import html_pages, html_text, url_filter, warc
from tallyweir.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"


# --- URLs --------------------------------------------------------------------------------------


def judged_plainly(url):
    after = url.split("://", 1)[1] if url and "://" in url else None
    if after is None:
        return "", "", None
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in URL_RULES:
        h, _, p = rule.rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.rule) > len(best.rule)):
            best = rule
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://A.Example.COM/en/1?x=1#y", "http://www.example.com/en/5",
    "http://www.example.com/fr/5", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://net/fr/1",
    "http://x.org/en/://y.com/", "http://h?q=/net/es/", "http://a.com", "http://É.com/\n/x", "ftp://user@x.net/fr/1#/", "http://x.com/#a",
    "http://x.org/" + "a/" * 5000,
]


def test_rules_and_the_rest(spark, frame):
    labelled = frame("url string, blocked int", *((f"http://casino-{i}.org/win/{i * 7919}", 1) for i in range(60)),
                     *((f"https://news.org/story/{i}", 0) for i in range(60)), (None, 1), ("http://x.org", None))
    model = url_filter.train(labelled)
    assert model.trees
    pages = frame("page_id bigint, url string, host int, rule int, suffix string", *((i, u, 1, 2, "s") for i, u in enumerate(URLS)),
                  (100, "http://casino-7.org/win/55433", None, None, None), (101, "https://news.org/story/9", None, None, None), (None, None, 0, 0, ""), (0, None, 1, 1, ""))
    rows = url_filter.judge(pages, model, URL_RULES).collect()
    assert len(rows) == len(URLS) + 4
    for r in rows:
        if r.page_id is not None and r.page_id < 100:
            host, path, rule = judged_plainly(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule and rule.rule)
            assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    verdict = {r.page_id: r.verdict for r in rows}
    assert (verdict[100], verdict[101]) == ("block", "allow")


def test_features_and_training_without_labels(spark, frame):
    rows = url_filter.with_host_and_path(frame("url string", ("http://a-b.x.org/p/q1?u=2&v=3",), ("",)))
    rows = rows.withColumn("suffix_share", F.lit(0.5)).withColumn("suffix_count", F.lit(1))
    first, empty = [r.asDict() for r in rows.select(*(c.alias(n) for n, c in url_filter.lexical_features().items())).collect()]
    url = "http://a-b.x.org/p/q1?u=2&v=3"
    import math
    from collections import Counter
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert first["entropy"] == pytest.approx(entropy) and empty["entropy"] == 0
    assert (first["url_length"], first["depth"], first["parameters"], first["host_hyphens"], first["host_labels"]) == (len(url), 2, 2, 1, 2)
    assert first["digit_ratio"] == pytest.approx(3 / len(url))
    model = url_filter.train(frame("url string, blocked int"))
    assert model.trees == [] and url_filter.judge(frame(PAGES, (1, "http://x.org/", "")), model, URL_RULES).first()["blocked_share"] == 0.5
    assert url_filter.judge(frame(PAGES), model, URL_RULES).count() == 0


def test_the_main_path_runs_no_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labelled = url_filter.labelled_pages(pages, labels)
    assert labelled.count() > 0
    plan = url_filter.judge(pages, url_filter.train(labelled, trees=2), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- main text ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_labelled_layouts_it_has_not_seen(model):
    right = total = 0
    for page in html_pages.labelled_pages(150, seed=77):
        blocks = html_text.blocks_of(page)
        features, owner, sizes = html_text._flat([blocks])
        labels = html_text.decode(model, html_text._scores(model.weights, features, owner, len(sizes)).tolist())
        right += sum(a == b.label for a, b in zip(labels, blocks, strict=True))
        total += len(blocks)
    assert right / total >= 0.98


def test_given_pages_yield_their_articles(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_text.extract(pages, model).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        article = re.sub(r"<(/?)(p|h1|br|b)>", lambda m: "" if m[2] == "b" else " ", article)
        wanted = " ".join(html.unescape(article).split())
        assert found[row.page_id].text == wanted and found[row.page_id].n_chars == len(wanted)


ODD = """<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site</p></div><header><h1>Site</h1></header>
<article><h1>Head &lt;line&gt;</h1><p>First <i>in</i>line&nbsp;text,
 with   space &#x41;&eacute;.</p><script>var p="<p>no</p>";</script><!-- gone --><p>Second part of the text, quite plain.<aside><p>Related: other things</p></aside></p>
<form><label>Mail</label><input><button>Send</button></form></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Ann</p><p>I liked this a lot, thanks.</p></div></section>
<footer>&copy; Site</footer></body></html>"""


def test_what_is_not_the_article_goes(frame, model):
    pages = frame("page_id bigint, url string, html string, text int, n_blocks string", (1, "u", ODD, 1, "x"), (2, None, None, 2, None), (3, "v", "", 1, None), (3, "v", "", 1, None), (None, "w", "<p>", 1, ""), (5, "x", "<div>" * 3000 + "deep", 1, ""))
    rows = html_text.extract(pages, model).collect()
    assert len(rows) == 6
    text = {r.page_id: r.text for r in rows}
    assert text[1] == "Head <line> First inline text, with space Aé. Second part of the text, quite plain."
    assert text[2] == text[3] == text[None] == ""
    assert html_text.extract(frame(PAGES), model).count() == 0


def test_viterbi_is_the_best_of_all_paths(model):
    import random
    rng = random.Random(2)
    for n in range(1, 7):
        scores = [rng.gauss(0, 2) for _ in range(n)]
        def value(path):
            return model.moves[2, path[0]] + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(s for s, p in zip(scores, path, strict=True) if p)
        assert value(html_text.decode(model, scores)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


# --- archives ----------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 4])
def test_archive_round_trip(spark, frame, folder, least):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (5, "u\r\nX: y", None), (4, "v", ""), (3, "w", "é"), (9, "x", "same"), (9, "x", "same"), (None, "y", "same"), (None, "z", "only here"), (0, "http://big/", "x" * 300_000)]
    pages = frame(PAGES + ", digest string, owner bigint", *((*r, "d", 7) for r in rows))
    found = warc.archive_pages(pages, folder + "/archive", least).collect()
    assert len(found) == len(rows)
    bodies = [(h or "").encode() for _, _, h in rows]
    for page, url, text in rows:
        body = (text or "").encode()
        own = [p for (p, _, _), b in zip(rows, bodies, strict=True) if b == body and p is not None]
        refers = min(own) if own and page != min(own) and len(body) >= least else None
        record = next(r for r in found if r.page_id == page and r.payload == body)
        assert (record.record_type, record.refers_to) == ("revisit" if refers is not None else "response", refers)
        assert record.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, _, rest = bytes(record.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        assert ("WARC-Target-URI" in fields) == (url is not None) and fields["WARC-Type"] == record.record_type
        assert rest[:-4].endswith(body) if record.record_type == "response" else rest.endswith(b"\r\n\r\n\r\n\r\n")
    stored = spark.read.parquet(folder + "/archive/payloads")
    assert stored.count() == len(set(bodies))


def test_damage_is_found_and_nothing_is_fine(spark, frame, folder):
    warc.write_archive(frame(PAGES, (1, "u", "text")), folder + "/a")
    spark.read.parquet(folder + "/a/payloads").withColumn("payload", F.lit(b"TEXT")).write.parquet(folder + "/b/payloads")
    spark.read.parquet(folder + "/a/records").write.parquet(folder + "/b/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, folder + "/b").select("payload").collect()
    assert warc.archive_pages(frame(PAGES), folder + "/none").count() == 0


def test_broken_and_deep_pages_in_time_that_grows_with_their_length():
    assert [b.text for b in html_text.blocks_of("<p>x" + "<b>y" * 100_000)] == ["x" + "y" * 100_000]
    names = ["".join(letters) for letters in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)][:15_000]
    deep = html_text.blocks_of("".join(f'<div class="{n}">w' for n in names))
    assert len(deep) == len(names)
    weights = np.random.default_rng(1).normal(size=1 << html_text.FEATURE_BITS).tolist()
    scores = html_text.page_scores(weights, deep)
    for at in (0, 7, 3_000, len(deep) - 1):
        assert scores[at] == pytest.approx(sum(weights[f] for f in deep[at].features))
        assert deep[at].size == len(deep[at].features)


def test_elements_end_as_they_would_in_a_browser():
    page = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<b>g</p>h</b><table><tr><td>i<td>j<tr><td>k</table></i>l"
    blocks = html_text.blocks_of(page)
    assert [b.text for b in blocks] == ["a", "b", "c", "d", "e", "fg", "h", "i", "j", "k", "l"]
    parents = [html_text._hashed(f"parent {t}") for t in ("li", "li", "li", "li", "p", "p", "", "td", "td", "td", "")]
    assert all(p in b.own for p, b in zip(parents, blocks, strict=True))
