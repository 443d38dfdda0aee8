"""Places where an operator once left something out."""

import random

from snapweave.llm import langid
from snapweave.llm.decontam import find_leaks, unsearched_items, without_leaks
from snapweave.llm.secrets import find_secrets


def test_without_labels_every_readable_document_stays(table_of):
    docs = table_of([(1, "some text", None, "s", 0), (2, "123 456", None, "s", 0), (3, None, None, "s", 0), (4, "ein Text", None, "s", 0)])
    network = langid.train(docs)
    assert network is None
    assert sorted(r.doc_id for r in langid.keep_readable(docs, network).collect()) == [1, 4]


def test_all_of_many_languages_are_learned(table_of):
    rng = random.Random(2)
    alphabets = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(20)] for k in range(70)}
    rows = [(n, "".join(rng.choice(alphabets[lang]) for _ in range(40)), lang, "s", 0) for n, lang in enumerate(sorted(alphabets) * 4)]
    network = langid.train(table_of(rows), docs_per_lang=3, steps=2)
    assert network.langs == sorted(alphabets)


def test_frequent_languages_keep_the_same_documents(table_of):
    """The cut by hash before the ranking takes nothing away that the ranking would keep."""
    rows = [(n, f"word{n} and more", "en" if n % 50 else "de", "s", 0) for n in range(3000)]
    assert langid.train(table_of(rows), docs_per_lang=5, steps=1).langs == ["de", "en"]


def test_short_items_are_found_as_whole_words(table_of, spark):
    items = spark.createDataFrame([(1, "What is 2+2?"), (2, "abc"), (3, "..."), (4, None), (5, "Name the capital of France, please.")], "item_id bigint, text string")
    docs = table_of(
        [
            (1, "Quiz: what is 2 2 of them", "en", "s", 0),
            (2, "what is 2 22", "en", "s", 0),
            (3, "what is 2 2", "en", "s", 0),
            (4, "abc", "en", "s", 0),
            (5, "so: name the capitol of France, please", "en", "s", 0),
            (6, "somewhat is 2 2", "en", "s", 0),
        ]
    )
    found = {(r.doc_id, r.item_id): (r.distance, r.budget, r.ends) for r in find_leaks(docs, items).collect()}
    assert set(found) == {(1, 1), (3, 1), (5, 5)}
    assert found[1, 1] == (0, 0, 16) and found[3, 1] == (0, 0, 11) and found[5, 5][0] == 1
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [2, 4, 6]
    assert {r.item_id: r.reason.split()[0] for r in unsearched_items(items).collect()} == {2: "too", 3: "no", 4: "no"}


def test_very_long_bare_keys_are_one_value(table_of):
    key = "".join(random.Random(3).choice("abcdefXYZ0123456789") for _ in range(400))
    rows = [(1, f"k {key} end", "en", "a", 0), (2, f"k {key} end", "en", "b", 0), (3, "A1b2C3d4E5f6G7h8I9" * 3, "en", "c", 0)]
    got = {r.doc_id: r for r in find_secrets(table_of(rows)).collect()}
    assert got[1].spans == got[2].spans and all(len(s.split(":")) == 3 for s in got[1].spans.split(",") if s)
    assert got[3].spans == "live:0:54" or "live" in got[3].spans


def test_values_planted_over_many_owners(table_of):
    """Owner counts against a plain version: which values are live, and where their bare copies are."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = ["".join(rng.choice(letters) for _ in range(20)) + "Aa11x" for _ in range(30)]
    rows, owners, repos = [], {v: set() for v in values}, {v: set() for v in values}
    for n in range(200):
        v, owner = rng.choice(values), f"o{rng.choice([0, 0, 0, 1, 2])}"
        bare = rng.random() < 0.5
        rows.append((n, f"note {v} here" if bare else f"password = {v}", "en", owner, 0))
        owners[v].add(owner)
        repos[v].add(n)
    assigned = {v for v in values if any(f"= {v}" in r[1] for r in rows)}
    live = {v for v in assigned if len(owners[v]) <= 1 and len(repos[v]) <= 5}
    got = {r.doc_id: r for r in find_secrets(table_of(rows)).collect()}
    for n, text, *_ in rows:
        v = text.split()[1] if text.startswith("note") else text.split()[2]
        if text.startswith("note") and v in assigned:
            assert ("live" in got[n].spans) == (v in live), text
        elif v in assigned:
            assert (got[n].n_live, got[n].n_example) == ((1, 0) if v in live else (0, 1))


def test_wrappers_with_telling_names_keep_their_article():
    from snapweave.llm import html

    text = lambda page: html.main_text(html.parse(page), frozenset())
    for name in ("page has-sidebar", "with-comments", "no-header", "social-feed"):
        assert text(f'<body><div class="{name}"><article><p>Hello world text.</p></article></div></body>') == "Hello world text."
    assert text('<article><p class="share-price">Up 3 %</p><p class="advert">Buy</p><div class="share-box">x</div></article>') == "Up 3 %"
    comments = '<div class="comments"><article><p>me too</p></article></div>'
    assert text(f"<body><p>The long text of a page without an article.</p>{comments}</body>") == "The long text of a page without an article."
    assert text(f"<body><div class='page no-header'><main><p>A text of some length.</p></main></div>{comments}</body>") == "A text of some length."
