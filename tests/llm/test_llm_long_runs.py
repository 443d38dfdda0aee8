"""Very long runs of one kind take one pass, and the patterns find what the plain ones find."""

import random
import re
import time

import pytest

from snapweave.llm import html, pii, spans
from snapweave.llm.tokens import WordCache

# The patterns as they are stated, without a thought for long runs.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "token": r"[^\s\"'<>()\[\]{},;]*[0-9@][^\s\"'<>()\[\]{},;]*",
}
FAST = {
    "email": lambda t: [m.span() for m in spans.EMAIL.finditer(t) if m[1]],
    "ip": lambda t: [m.span() for m in spans.IP.finditer(t) if m[1]],
    "token": lambda t: [m.span() for m in pii.TOKEN.finditer(t)],
}


@pytest.mark.parametrize("name, letters", [("email", "a1.%@@-  "), ("ip", "12..  x"), ("token", "ab1@ ,;'x")])
def test_same_matches_as_the_plain_pattern(name, letters):
    rng, plain = random.Random(4), re.compile(PLAIN[name])
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        assert FAST[name](text) == [m.span() for m in plain.finditer(text)], text


MILLION = 1_000_000
RUNS = {
    "letters": "a" * MILLION,
    "letters and an address": "a" * MILLION + " x@y.z",
    "an address without end": "x@" + "a" * MILLION,
    "digits": "1" * MILLION,
    "dotted": "1." * (MILLION // 2) + "x",
    "at signs": "a@" * (MILLION // 2),
    "white space": " " * MILLION,
}


@pytest.mark.parametrize("name", RUNS)
def test_scans_of_long_runs_end(name):
    start = time.process_time()
    list(spans.private_spans(RUNS[name]))
    list(spans.secret_spans(RUNS[name]))
    list(pii.TOKEN.finditer(RUNS[name]))
    assert time.process_time() - start < 5


PAGES = {
    "open tags": "<a " * (MILLION // 3),
    "open tags, then an end": "<a " * (MILLION // 3) + ">",
    "quotes": "<a \"'" * (MILLION // 5) + ">",
    "declarations": "<! " * (MILLION // 3),
    "comments": "<!-- " * (MILLION // 5),
    "end tags": "</ " * (MILLION // 3),
    "ends": ">" * MILLION,
}


@pytest.mark.parametrize("name", PAGES)
def test_parsing_of_long_runs_ends(name):
    start = time.process_time()
    html.main_text(html.parse("<p>first</p>" + PAGES[name]), frozenset())
    assert time.process_time() - start < 5


def test_unclosed_markup():
    text = lambda page: html.main_text(html.parse(page), frozenset())
    assert text("<p>a</p><!-- b <p>c</p>") == "a"
    assert text("<p>a</p><!-- b") == "a"
    assert text("<p>a</p> 1 < 2") == "a 1 < 2"
    assert text("<p title=\"x>y\">a</p>") == "a"
    assert text("<p>a <b title='x>b</b> c</p>") == "a b c"


def test_neighbouring_words_at_any_distance():
    far = "call me" + " " * 500 + "77-88" + "." * 300 + "now"
    start = far.index("77-88")
    assert pii.Contexts(far).of(start, start + 5) == ["call me _", "me _ now"]
    assert pii.Contexts("77-88").of(0, 5) == [] and pii.Contexts("mail 77-88").of(5, 10) == []
    near = pii.Contexts("my id x12y34z is")
    assert near.of(6, 13) == ["my id _", "id _ is"]


def test_support_counts_documents(table_of):
    """Three addresses in one document make no pattern; in three documents they do."""
    lone = [(1, "user name a@b.cd user name b@b.cd user name c@b.cd", "en", "s", 0), (2, "user name x77-8899", "en", "s", 0)]
    assert all(r.n_context == 0 for r in pii.find_private(table_of(lone)).collect())
    many = [(n, f"user name {n}@b.cd", "en", "s", 0) for n in range(1, 40)] + [(50, "user name x77-8899", "en", "s", 0)]
    got = {r.doc_id: r for r in pii.find_private(table_of(many)).collect()}
    assert got[50].n_context == 1 and got[50].spans == "context:10:18"


def test_words_used_again_outlive_a_generation():
    import public_tokenizers

    cache = WordCache(public_tokenizers.path("byte_bpe_50k.json"), cached_words=40)
    texts = [" ".join(["kept", *[f"w{n}x{k}" for k in range(9)]]) for n in range(30)]
    want = [x.ids for x in cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    got = [cache.encode([t])[0].tolist() for t in texts]
    assert got == want and len(cache.place) <= 40 and len(cache.older[0]) <= 40
    assert "kept" in cache.place or "kept" in cache.older[0] or any("kept" in k for k in cache.older[0])


def test_a_lent_cache_is_kept_for_a_moment(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr("snapweave.llm.tokens.IDLE_SECONDS", 0.2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    with WordCache.lent(path) as first:
        first.encode(["a b"])
    with WordCache.lent(path) as second:
        assert second is first
    time.sleep(0.6)
    assert WordCache._kept is None
