import collections
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.llm import langid
from snapweave.llm.html import extract_main_text, main_text, parse
from snapweave.llm.urls import judge_urls, parse_rule

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
PAGES = "page_id bigint, url string, html string"


def text_of(source):
    return main_text(parse(source), frozenset())


def test_main_text_of_single_pages():
    assert text_of("<body><nav>m</nav><article><h1>T&amp;a</h1><p>a<b>b</b>c<p>d\n <i>e</i><br>f</article><footer>x</footer>") == "T&a abc d e f"
    assert text_of('<main>a<div class="ad">no</div><div id="comments"><p>no</div>b<form>no</form></main>') == "a b"
    assert text_of("<p>only</p><script>var t='</p>'</script><style>p{}</style><p>this") == "only this"
    assert text_of("") == "" and text_of("no markup &lt;here&gt;") == "no markup <here>"
    assert text_of("<article><a href='x>y'>k</a> <!-- c --> <td>1<td>2</article>") == "k 1 2"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_templates_of_a_site_go_and_its_text_stays(table_of):
    random.seed(2)
    words = lambda n: " ".join(random.choice("abcdefgh") * random.randint(2, 6) for _ in range(n))
    rows, want = [], {}
    for n in range(12):
        body = words(30)
        page = f"<body><div class=top><ul><li>Home<li>News</ul></div><div>{body}</div><p>Same line</p><section>All rights kept</section></body>"
        rows.append((n, f"http://Site.example/{n}", page))
        want[n] = body
    for n in range(20, 26):
        rows.append((n, f"http://other.example/{n}", f"<article><p>Same line</p><p>{words(5)} {n}</p></article>"))
    rows += [(40, "http://copy.example/a", "<div>one page, many copies</div>")] * 9
    rows += [(90, None, None), (91, "no host", ""), (92, None, "<p>x</p>")]
    got = {r.page_id: r for r in extract_main_text(table_of(rows, PAGES, clash=False)).collect()}
    for n, body in want.items():
        assert got[n].text == " ".join(body.split())
    assert all(got[n].text.startswith("Same line") for n in range(20, 26))
    assert got[40].text == "one page, many copies"
    assert got[90].text == "" and got[90].n_chars == 0 and got[91].text == "" and got[92].text == "x"
    assert extract_main_text(table_of([], PAGES)).count() == 0


@needs_data
def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br)>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(inner).split())


RULES = [parse_rule(t) for t in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def test_url_rules(table_of):
    urls = {
        1: ("http://a.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
        3: ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("http://x.com/de/1#f", "x.com", "/de/1", "com/de/", "block"),
        5: ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        6: ("http://notexample.org", "notexample.org", "", None, "allow"),
        7: ("http://myorg/es/", "myorg", "/es/", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("mailto:a@b.org/", "", "", None, "allow"),
        10: ("x://y://z.org/", "y:", "//z.org/", None, "allow"),
    }
    rows = [(n, u[0], None) for n, u in urls.items()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(table_of(rows, PAGES), RULES).collect()}
    assert got == {n: u[1:] for n, u in urls.items()}
    assert judge_urls(table_of([], PAGES), RULES).count() == 0


def test_blocks_spread_over_redirects_and_allows_hold(table_of):
    link = lambda u: f'<html><LINK href="{u}" rel=canonical></html>'
    rows = [
        (1, "http://a.net/1", link("http://bad.com/de/9")),
        (2, "http://b.net/2", '<meta http-equiv="refresh" content="0; url=http://a.net/1?x">'),
        (3, "http://c.org/3", link("http://b.net/2")),
        (4, "http://d.net/4", link("/other")),
        (5, "http://d.net/other?z=1", ""),
        (6, "http://b.net/2#frag", None),
        (7, "http://e.net/7", link("")),
    ]
    got = {r.page_id: r.verdict for r in judge_urls(table_of(rows, PAGES, clash=False), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}


def test_gradients_are_those_of_differences():
    draw = np.random.default_rng(0)
    network = langid.Network.fresh(["a", "b", "c"], hidden=3)
    x, y = draw.integers(0, 256, (6, 5)), draw.integers(0, 3, 5)
    _, grads = network.gradients(x, y)
    for name, weight in network.weights.items():
        for _ in range(4):
            place = tuple(draw.integers(0, n) for n in weight.shape)
            if name.startswith("E"):
                place = (place[0], int(x[0, 0]))
            old, step, sides = weight[place], 1e-2, []
            for sign in (1, -1):
                weight[place] = old + sign * step
                sides.append(network.gradients(x, y)[0])
            weight[place] = old
            assert abs((sides[0] - sides[1]) / (2 * step) - grads[name][place]) < 2e-3


def test_document_probabilities_pool_every_position():
    network = langid.Network.fresh(["a", "b"], hidden=3)
    texts = [b"x", b"ab" * 40, b"q" * langid.WINDOW, b"long text " * 300]
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = network.document_probabilities(np.frombuffer(b"".join(texts), np.uint8), cuts[:-1], cuts[1:])
    assert np.allclose(found.sum(axis=1), 1, atol=1e-5)
    for text, got in zip(texts, found, strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), langid.WINDOW):
            begin = min(at, max(0, len(text) - langid.WINDOW))
            window = np.frombuffer(text[begin : begin + langid.WINDOW].ljust(langid.WINDOW), np.uint8)[:, None]
            labels = network.label_positions(window)[:, :, 0]
            total += labels[at - begin : min(langid.WINDOW, len(text) - begin)].sum(axis=0)
        assert np.allclose(got, total / len(text), atol=1e-5)


@pytest.fixture(scope="module")
def small_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(docs, docs_per_lang=120, steps=120)


@needs_data
def test_held_out_accuracy(spark, small_network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, small_network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in langid.predict(docs, None).collect())


@needs_data
def test_language_of_awkward_documents(awkward, nothing, small_network):
    from llm_cases import AWKWARD

    got = langid.predict(awkward, small_network).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in AWKWARD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 8}
    kept = langid.keep_readable(awkward, small_network)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 4
    assert langid.train(nothing) is None and langid.predict(nothing, None).count() == 0
    assert langid.keep_readable(nothing, None).count() == 0


def test_training_ignores_the_held_out_fold(table_of):
    rows = [(n, "some text", "aa" if zlib.crc32(str(n).encode()) % 3 == 1 else "bb", "s", 0) for n in range(60)]
    assert langid.train(table_of(rows), steps=2).langs == ["bb"]


@needs_data
def test_pipeline_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline
    from snapweave.llm.decontam import Matcher, SHARE, plain
    from test_llm_similarity import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    bench = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    readable = [d for d in docs if d.text and re.search(r"[^\W\d_]", d.text)]
    first = {number for number, _, component in brute_components([tuple(d) for d in readable]) if number == component}
    matcher = Matcher(bench, SHARE)
    want = {d.doc_id for d in readable if d.doc_id in first and not matcher.find(plain(d.text))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want
    full = collections.Counter()
    for r in got:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]


@needs_data
def test_stages_keep_the_columns_of_documents_in_any_table(spark, table_of, awkward, nothing):
    import corpus_pipeline

    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                out.count()
            else:
                assert out.columns == docs.columns, name
                assert out.count() <= docs.count()
