"""Cases of the second advice: places where an operator once did less than the whole job."""

import pytest

from snapweave.llm.jaccard import near_duplicates, without_near_duplicates
from snapweave.llm.secrets import MASK, find_secrets, mask_live_secrets

PLAIN = {
    "short": "abcdefghijkl",
    "dots": "eyJhbGci.eyJzdWIi.SflKxwRJ",
    "stop": "correcthorsebattery.",
    "long": "Ab3" * 60,
    "letters": "correct-horse-battery-staple",
    "padded": "QUJDREVGR0hJSktMTU5P==",
    "hexed": "sk-0123456789abcdef0123Z",
}


@pytest.mark.parametrize("name", PLAIN)
def test_bare_copies_of_any_base_value_are_found(table_of, name):
    value = PLAIN[name]
    bare = value.rstrip(".")
    rows = [(1, f"password = {value}", "en", "a", 0), (2, f"quoted {bare} here", "en", "a", 0), (3, f"x={bare}. End", "en", "a", 0)]
    rows += [(4, f"q{bare} {bare}q {bare[:11]}", "en", "a", 0)]
    docs = table_of(rows)
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert f"live:7:{7 + len(bare)}" in got[2].spans.split(",") and f"live:2:{2 + len(bare)}" in got[3].spans.split(",")
    assert name in ("hexed", "long") or got[4].spans == ""
    masked = {r.doc_id: r.text for r in mask_live_secrets(docs).collect()}
    assert masked[1] == f"password = {MASK}" and masked[2] == f"quoted {MASK} here" and masked[3] == f"x={MASK}. End"


def test_bare_copies_count_for_the_owners_of_a_value(table_of):
    rows = [(1, "token = abcdefgh.ijkl", "en", "a", 0)] + [(n, "as in abcdefgh.ijkl", "en", f"o{n}", 0) for n in range(2, 6)]
    got = {r.doc_id: r for r in find_secrets(table_of(rows)).collect()}
    assert (got[1].n_live, got[1].n_example) == (0, 1) and all(got[n].spans == "" for n in range(2, 6))


def test_examples_copied_within_one_source_are_no_live_secrets(table_of):
    example, live, lone = "q1w2e3r4t5y6u7i8o9p0", "Zk3vQ9xT7mW2pL8sD4", "Hn4cR8bY6jK1fG5aS2"
    rows = [(n, f"password: {example} and bare {example}.", "en", "hot", 0) for n in range(1, 31)]
    rows += [(n, f"secret: {live}", "en", "hot", 0) for n in (40, 41)]
    rows += [(n, f"token = {lone}", "en", None, 0) for n in (50, 51)]
    rows += [(60, "token = onlyhereonce", "en", None, 0), (None, "password=nodocid12345", "en", "hot", 0)]
    docs = table_of(rows)
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert all((got[n].n_live, got[n].n_example) == (0, 1) and "live" not in got[n].spans for n in range(1, 31))
    assert got[40].n_live == 1 and got[60].n_live == 1 and got[None].n_live == 1
    assert (got[50].n_live, got[50].n_example) == (0, 1)
    masked = {r.doc_id: r.text for r in mask_live_secrets(docs).collect()}
    assert masked[1] == rows[0][1] and masked[40] == f"secret: {MASK}" and masked[50] == f"token = {lone}"


@pytest.fixture
def shifting(monkeypatch):
    """Splits change with every reading that numbers rows, as they do when cores come and go."""
    from pyspark.sql import functions as F

    true, calls = F.monotonically_increasing_id, []

    def moved():
        calls.append(1)
        return true() + F.lit(1000 * len(calls)) if len(calls) > 1 else true()

    monkeypatch.setattr(F, "monotonically_increasing_id", moved)


def test_row_numbers_hold_when_splits_change(table_of, shifting):
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*words[:-1], f"x{n}"]), "en", "s", 0) for n in range(4)]
    rows += [(10 + n, " ".join(f"d{n}v{i}" for i in range(40)), "en", "s", 0) for n in range(4)]
    docs = table_of(rows)
    assert {r.doc_id for r in without_near_duplicates(docs).collect()} == {0, 10, 11, 12, 13}


def test_component_numbers_hold_when_splits_change(table_of, shifting):
    words = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*words[:-1], f"x{n}"]), "en", "s", 0) for n in range(4)] + [(9, "one two three four five six", "en", "s", 0)]
    assert {r.doc_id: r.component_id for r in near_duplicates(table_of(rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_the_right_documents_are_masked_when_splits_change(table_of, shifting):
    value = "Zk3vQ9xT7mW2pL8sD4"
    rows = [(1, "nothing to see in this one", "en", "a", 0), (2, f"token = {value}", "en", "a", 0), (3, "nor is there here", "en", "a", 0)]
    masked = {r.doc_id: r.text for r in mask_live_secrets(table_of(rows)).collect()}
    assert masked == {1: rows[0][1], 2: f"token = {MASK}", 3: rows[2][1]}
