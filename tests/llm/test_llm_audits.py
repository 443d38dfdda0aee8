"""Merkle manifest, filter audit and toxicity against plain versions on small tables."""

import itertools
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import AWKWARD, SCHEMA
from snapweave.llm import merkle, toxicity
from snapweave.llm.filter_audit import audit_documents, flag_repeats
from snapweave.llm.rows import numbered

LABELS = "doc_id bigint, quality int, toxic int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest ---


def plain_tree(leaves):
    """Levels of nodes and, per leaf, (left siblings, right siblings) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for n, k in enumerate(at):
            run = k - k % 3
            paths[n].append((level[run:k], level[k + 1 : run + 3]))
            at[n] = k // 3
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    def leaf(row, text):
        return h(*[field(v) for v in (row[0], row[3], row[2], row[4], text)])

    sources = {}
    for row in rows:
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        claim = row[1].replace("\n", "") if even and row[1] is not None else row[1]
        sources.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, claim)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (known, doc_id, own, claim), path in zip(sorted(sources[s]), trees[s][1]):
            folded, proof = claim, ""
            for left, right in path + top:
                folded, proof = h(*left, folded, *right), proof + "".join(left + right)
            out.append((doc_id if known else None, own, trees[s][0], root, h(proof), folded, folded == root))
    return out


def same_rows(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_manifest_of_awkward_rows(awkward, nothing):
    assert same_rows(merkle.document_manifest(awkward).collect(), plain_manifest(AWKWARD))
    assert merkle.document_manifest(nothing).collect() == []


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 4, 9, 10, 28], [1] * 11])
def test_manifest_of_many_sources(table_of, sizes):
    rows = [(s * 1000 + n, f"a\nb {n}", "en", None if s == 3 else f"s{s}é", n) for s, size in enumerate(sizes) for n in range(size)]
    random.Random(3).shuffle(rows)
    got = merkle.document_manifest(table_of(rows)).collect()
    assert same_rows(got, plain_manifest(rows))
    changed = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 2 == 0]
    assert all(not r.verified and r.folded_root != r.root for r in changed) and sum(r.verified for r in got) == len(got) - len(changed)


def test_bands_of_small_blocks(monkeypatch):
    """Blocks of nine leaves, four bands: the steps of the workers in this process."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    leaves = [h(str(n)) for n in range(800)]
    shapes, siblings, level, at = [""] * 800, [b""] * 800, [bytes.fromhex(x) for x in leaves], list(range(800))
    while True:
        size, roots = len(level), []
        blocks = [(level[k : k + 9], merkle.height_of(size)) for k in range(0, size, 9)]
        stores = [merkle.build_block(x, height) for x, height in blocks]
        for n, k in enumerate(at):
            own, height = blocks[k // 9]
            shape, path = merkle.path_in_block(stores[k // 9], height, len(own), k % 9)
            shapes[n], siblings[n], at[n] = shapes[n] + shape, siblings[n] + path, k // 9
        level = [s[: merkle.BYTES] for s in stores]
        if size <= 9:
            break
    root, plain_paths = plain_tree(leaves)
    assert level[0].hex() == root
    assert [s.hex() for s in siblings] == ["".join("".join(a + b) for a, b in p) for p in plain_paths]
    assert all(merkle.fold_path(bytes.fromhex(x), shape, s).hex() == root for x, shape, s in zip(leaves, shapes, siblings))


def test_a_source_of_several_blocks(spark, tmp_path):
    rows = [(n, f"text {n}", "en", "hot" if n % 5 else "cold", n) for n in range(9000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    got = merkle.document_manifest(spark.read.parquet(str(tmp_path / "t")))
    assert same_rows(got.collect(), plain_manifest(rows))


@pytest.mark.parametrize("height", range(7))
def test_van_emde_boas_order(height):
    """Each node has a place of its own; the upper half of the levels comes first; subtrees are contiguous."""
    at = merkle.places(height)
    assert sorted(itertools.chain.from_iterable(at)) == list(range(merkle.count_nodes(height + 1)))
    upper = (height + 1) // 2
    if upper:
        assert sorted(itertools.chain.from_iterable(at[:upper])) == list(range(merkle.count_nodes(upper)))
        size = merkle.count_nodes(height + 1 - upper)
        for k in range(3**upper):
            own = [at[d][i] for d in range(upper, height + 1) for i in range(k * 3 ** (d - upper), (k + 1) * 3 ** (d - upper))]
            first = merkle.count_nodes(upper) + k * size
            assert sorted(own) == list(range(first, first + size))


# --- filter audit ---


def plain_audit(docs, labels):
    known = {}
    for doc_id, quality, toxic in labels:
        a, b = known.get(doc_id, (False, False))
        known[doc_id] = (a or quality == 1, b or toxic == 1)
    ids = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            ids.setdefault(text or "", []).append(doc_id)
    rows = []
    for doc_id, text, _, source, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and doc_id > min(ids[t]),
        }
        good, toxic = known.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        rows.append((source or "", {f for f in fails if fails[f]}, good, toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = [r for r in rows if r[0] == part and f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit_rows(docs, labels):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(map(tuple, audit_documents(docs, labels).select(*columns).collect()))


def test_audit_against_a_plain_version(table_of):
    rng = random.Random(5)
    words = ["plain", "Words", "ABC", "a|b", "x", "y", "z"]
    docs = []
    for n in range(150):
        text = " ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.choice([3, 49, 50, 60])))
        docs.append((n, text, "en", rng.choice(["a", "b", None, ""]), 0))
    docs += [(200 + n, docs[n][1], "en", "a", 0) for n in range(40)] + [(300, " ".join(f"w{i}" for i in range(60)), "en", "b", 0)]
    labels = [(n, n % 2, (n // 2) % 2) for n in range(0, 240, 3)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)]
    assert audit_rows(table_of(docs), table_of(labels, LABELS)) == plain_audit(docs, labels)


def test_audit_of_awkward_rows(awkward, nothing, table_of):
    labels = [(5, 1, 1), (2, 1, 0), (None, 1, 1)]
    assert audit_rows(awkward, table_of(labels, LABELS)) == plain_audit(AWKWARD, labels)
    assert audit_rows(nothing, table_of(labels, LABELS)) == []
    assert audit_rows(awkward, table_of([], LABELS)) == plain_audit(AWKWARD, [])


def test_audit_leaves_no_tables_behind(awkward, table_of, spark):
    before = {t.name for t in spark.catalog.listTables()}
    audit_documents(awkward, table_of([], LABELS)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_repeats_of_a_hot_text(spark, monkeypatch):
    """A text with most of the rows meets its least number by broadcast, the others by join, with the same result."""
    from snapweave.llm import filter_audit

    monkeypatch.setattr(filter_audit, "HOT_SHARE", 10**9)
    rows = [(n, "hot" if n % 3 else f"t{n % 30}") for n in range(6000)] + [(None, "hot"), (0, "hot")]
    df = numbered(spark.createDataFrame(rows, "doc_id bigint, same string"))
    got = Counter((r.doc_id, r.same, r.E) for r in flag_repeats(df, "same", "doc_id", "E").collect())
    least = {s: min(i for i, t in rows if t == s and i is not None) for _, s in rows}
    assert got == Counter((i, s, i is not None and i > least[s]) for i, s in rows)


# --- toxicity ---


def events(text):
    """Kinds of event by a plain reading of the three rules, word by word."""
    words, listed = toxicity.TOKEN.findall(text.lower()), toxicity._listed()
    insults = set(" ".join(toxicity.INSULTS).split())
    kind = [listed.get(w, toxicity.INSULT if w in insults else toxicity.NEGATION if w.endswith("n't") else toxicity.OTHER) for w in words]
    out = Counter()
    for n, k in enumerate(kind):
        if k not in (toxicity.INSULT, toxicity.THREAT):
            continue
        begin = max([i + 1 for i in range(n) if kind[i] in (toxicity.END, toxicity.LINE)], default=0)
        line = max([i + 1 for i in range(n) if kind[i] == toxicity.LINE], default=0)
        before = [i for i in range(begin, n) if kind[i] != toxicity.QUOTE]
        if any(kind[i] == toxicity.NEGATION for i in before[-toxicity.REACH :]):
            out["denied"] += 1
        elif toxicity.REPORT in kind[begin:n] or kind[line:n].count(toxicity.QUOTE) % 2:
            out["said"] += 1
        elif k == toxicity.INSULT:
            out["aimed" if any(kind[i] == toxicity.TARGET for i in range(max(begin, n - toxicity.REACH), n)) else "direct"] += 1
        else:
            for i in range(n + 1, min(len(kind), n + 1 + toxicity.REACH)):
                if kind[i] in (toxicity.END, toxicity.LINE, toxicity.TARGET) or kind[i] == toxicity.THREAT:
                    out["menace"] += kind[i] == toxicity.TARGET
                    break
    return {k: v for k, v in out.items() if v}


CASES = {
    "you are an idiot": {"aimed": 1},
    "what an idiot": {"direct": 1},
    "you are not an idiot": {"denied": 1},
    "she isn't stupid": {"denied": 1},
    "he said you are an idiot": {"said": 1},
    "he said so. you idiot": {"aimed": 1},
    '"you idiot" was on the wall': {"said": 1},
    '"open\nyou idiot': {"aimed": 1},
    "not. an idiot": {"direct": 1},
    "i will kill you": {"menace": 1},
    "i will kill time": {},
    "i will not kill you": {"denied": 1},
    "stupid, stupid": {"direct": 2},
    "": {},
}


@pytest.mark.parametrize("text", CASES)
def test_clauses(text):
    found, _ = toxicity.Scorer(toxicity.Grammar()).clauses(text)
    sums = np.array(found).sum(0) / toxicity.SEED_WEIGHT if found else np.zeros(toxicity.KINDS)
    got = {k: n for k, n in zip(["direct", "aimed", "menace", "said", "denied"], sums.tolist()) if n}
    assert got == CASES[text] == events(text)


def test_machine_against_plain_rules():
    rng = random.Random(1)
    scorer = toxicity.Scorer(toxicity.Grammar())
    pool = ["idiot", "scum", "you", "not", "said", "word", "word", "other", ".", "\n", "never", "they"]
    for _ in range(3000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))
        found, n_words = scorer.clauses(text)
        sums = np.array(found).sum(0) / toxicity.SEED_WEIGHT if found else np.zeros(toxicity.KINDS)
        got = {k: n for k, n in zip(["direct", "aimed", "menace", "said", "denied"], sums.tolist()) if n}
        assert got == events(text), text
        assert n_words == sum(t not in ".\n" for t in toxicity.TOKEN.findall(text))


def test_context_lowers_the_score():
    score = toxicity.Scorer(toxicity.Grammar()).score
    assert score("you are an idiot, you worthless scum") > score("he said you are an idiot") > score("a quiet word") - 0.2
    assert score("you are an idiot") > score("you are not an idiot")


def toxic_corpus(n=1200):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grobz" + rng.choice(plain)[:3])
        elif i % 17 == 0:
            words.insert(rng.randrange(len(words)), "grobz" + rng.choice(plain)[:3])
        docs.append((i, " ".join(words) + ".", None, None, 0))
        labels.append((i, 0, int(bad)))
    return docs, labels


def test_stems_are_learned_and_held_out_documents_judged(table_of):
    docs, labels = toxic_corpus()
    got = {r.doc_id: r for r in toxicity.judge_documents(table_of(docs), table_of(labels, LABELS)).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    right = sum(got[i].predicted == labels[i][2] for i in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_and_other_columns_are_not_read(table_of):
    docs, labels = toxic_corpus(400)
    first = {r.doc_id: r.score for r in toxicity.judge_documents(table_of(docs), table_of(labels, LABELS)).collect()}
    turned = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in labels]
    again = toxicity.judge_documents(table_of([(i, t, "xx", "yy", 5) for i, t, *_ in docs], clash=True), table_of(turned, LABELS))
    assert {r.doc_id: r.score for r in again.collect()} == first


def test_copies_count_once(table_of):
    docs, labels = toxic_corpus(400)
    many = [(10_000 + n, "the zzzq copied words of one lone text here again", None, None, 0) for n in range(200)]
    sample = toxicity.labelled_sample(table_of(docs + many), table_of(labels + [(d[0], 0, 1) for d in many], LABELS), 10_000)
    assert sample.filter(F.col("text").contains("zzzq")).count() == 1
    assert "=zzzq" not in toxicity.learn_stems(sample)


def test_awkward_rows_and_no_labels(awkward, nothing, table_of):
    for labels in (table_of([], LABELS), table_of([(5, 1, 1), (7, 0, 1)], LABELS), table_of([(4, 1, 1), (7, 0, 0), (8, None, None)], LABELS)):
        got = toxicity.judge_documents(awkward, labels).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.judge_documents(nothing, table_of([], LABELS)).collect() == []


def test_a_very_long_text():
    scorer = toxicity.Scorer(toxicity.Grammar())
    assert scorer.clauses("a" * 1_000_000)[1] == 1
    assert scorer.clauses("you idiot. " * 100_000)[1] == 200_000
