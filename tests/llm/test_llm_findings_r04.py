"""Findings of round 04."""

from snapweave.llm import langid


def test_documents_without_a_language_get_the_named_one(table_of):
    rows = [(n, "abc " * 30 if n % 2 else "xyz " * 30, "aa" if n % 2 else "bb", "s", 0) for n in range(60)]
    network = langid.train(table_of(rows), steps=60)
    asked = table_of([(100, "abc " * 30, None, "s", 0), (101, "xyz " * 30, None, "s", 0), (102, "xyz " * 30, "aa", "s", 0), (103, "12", None, "s", 0)])
    kept = langid.keep_readable(asked, network)
    assert kept.schema == asked.schema
    assert {r.doc_id: r.lang for r in kept.collect()} == {100: "aa", 101: "bb", 102: "aa"}
    assert sorted(map(str, kept.drop("lang").collect())) == sorted(map(str, asked.filter("doc_id < 103").drop("lang").collect()))
