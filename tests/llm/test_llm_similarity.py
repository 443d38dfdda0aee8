import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from snapweave.llm import jaccard, shingles
from snapweave.llm.components import connected_components
from snapweave.llm.topk import exact_top_k, tile_top
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute_components(docs):
    """Component of each row by all pairs of texts that share a shingle."""
    sets = [shingle_set(text) for _, text, *_ in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    numbers = collections.defaultdict(list)
    for k in range(len(docs)):
        numbers[root(k)].append(docs[k][0])
    out = collections.Counter()
    for k, doc in enumerate(docs):
        own = [n for n in numbers[root(k)] if n is not None]
        out[doc[0], len(sets[k]), (min(own) if own else None) if sets[k] else doc[0]] += 1
    return out


def corpus(seed, copies=60):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 5)))
    passages = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(260):
        own = [word() for _ in range(random.choice([1, 3, 5, 6, 8, 30, 90, 200]))]
        if k % 3 == 0:
            own = own[: len(own) // 2] + random.choice(passages) + own[len(own) // 2 :]
        if k % 11 == 0:
            own = passages[0] + passages[1] + own[:6]
        texts.append(own)
    base = [word() for _ in range(150)]
    for _ in range(copies):
        near = list(base)
        for _ in range(random.randint(0, 7)):
            near[random.randrange(len(near))] = word()
        texts.append(near)
    for own in random.sample(texts, 60):
        near = list(own)
        for _ in range(random.randint(0, max(1, len(near) // 20))):
            place = random.randrange(len(near))
            if random.random() < 0.5 and len(near) > 1:
                del near[place]
            else:
                near.insert(place, word())
        texts.append(near)
    texts += [base] * copies
    return [(n, " ".join(t).capitalize(), "en", "s", 0) for n, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_that_of_brute_force(table_of, seed):
    docs = corpus(seed)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table_of(docs)).collect())
    assert got == brute_components(docs)


def test_join_of_awkward_documents(awkward, nothing):
    from llm_cases import AWKWARD

    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(awkward).collect())
    assert got == brute_components(AWKWARD)
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    # Six rows hold the same six words; rows without words stay.
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 4, 5, 8, 9, 10]
    assert jaccard.without_near_duplicates(nothing).count() == 0


def test_shingles_are_those_of_single_texts():
    texts = ["", "a", "a b", " a  b\tc\nd e f ", "é ê", "x", "a b c d e", "q" * 3000, "A b C d E f g"]
    data = [t.encode() for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    sets, borders = shingles.shingle_sets(np.frombuffer(b"".join(data), np.uint8), cuts)
    assert np.diff(borders).tolist() == [len(shingle_set(t)) for t in texts]
    for k, one in enumerate(data):
        alone, _ = shingles.shingle_sets(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
        assert alone.tolist() == sets[borders[k] : borders[k + 1]].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 20, 63, 64, 65, 85, 86, 127, 128, 170, 171, 400, 1000])
def test_linked_sets_share_a_key(n):
    draw = np.random.default_rng(n)
    for _ in range(30):
        own = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64) * 2)
        n = len(own)
        # As different as a link allows, in several proportions of missing and new elements.
        gone = int(draw.integers(0, n // 4 + 1))
        most = int((n - gone) / 0.75 - n + 1e-9)
        new = np.unique(draw.integers(0, 2**63, int(draw.integers(0, max(0, most) + 1)), dtype=np.uint64) * 2 + 1)
        other = np.sort(np.concatenate([draw.permutation(own)[gone:], new]))
        if not len(other) or 4 * (n - gone) < 3 * (n + len(new)):
            continue
        assert set(shingles.signature(own)) & set(shingles.signature(other))
        words, cuts = shingles.parity_sketches(np.concatenate([own, other]), np.array([0, n, n + len(other)]))
        a, b = words[: cuts[1]], words[cuts[1] :]
        if len(a) > len(b):
            a = a[: len(b)] ^ a[len(b) :]
        if len(b) > len(a):
            b = b[: len(a)] ^ b[len(a) :]
        apart = sum(bin(x & 0xFFFFFFFFFFFFFFFF).count("1") for x in (a ^ b).tolist())
        assert apart <= gone + len(new)


def test_groups_pass_through_in_runs(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_ROWS", 7)
    rows = [(1, 5)] + [(2, n) for n in range(40)] + [(3, 9), (3, 9)] + [(4, 8), (4, 3)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 5]]), pa.array([n for _, n in rows[i : i + 5]])], names=["key", "node"])
        for i in range(0, len(rows), 5)
    ]
    got = [r for b in jaccard._groups_in_order(iter(batches)) for r in b.to_pylist()]
    assert [(r["key"], r["node"]) for r in got] == [x for x in rows if x[0] in (2, 4)]
    assert {r["leader"] for r in got if r["key"] == 2} == {0} and {r["leader"] for r in got if r["key"] == 4} == {3}
    assert all(r["size"] >= 7 for r in got if r["key"] == 2)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    random.seed(seed)
    edges = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    edges += [(300, n) for n in range(301, 350)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    real = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: root(n) for n in real}


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_top(rows, k):
    clean = [(n, [int(np.floor(64 * x)) for x in v]) for n, v in rows if n is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, own in clean:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), n) for n, v in clean if n != q and len(v) == len(own))
            out += [(q, r + 1, n, -s) for r, (s, n) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_is_that_of_brute_force(table_of):
    random.seed(9)
    rows = [(n, [random.choice([-0.5, 0.25, 0.125]) for _ in range(4)]) for n in range(300)]
    rows += [(400, None), (420, []), (440, [None, 1.0, 1.0, 1.0]), (460, [float("nan")] * 4), (None, [1.0] * 4), (480, [1.0, 2.0])]
    docs = table_of(rows, "vec_id bigint, embedding array<float>", clash=True)
    got = exact_top_k(docs, F.col("vec_id") % 20 == 0, k=7, query_block=4, shard=32, fan=3)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 7)


def test_top_k_of_few_and_no_vectors(table_of):
    schema = "vec_id bigint, embedding array<float>"
    few = [(0, [1.0]), (1, [1.0]), (2, [1.0])]
    assert sorted(map(tuple, exact_top_k(table_of(few, schema), F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 1, 4096), (0, 2, 2, 4096)]
    assert exact_top_k(table_of([], schema), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 10**5, 10**8])
def test_tiles_are_exact_for_large_components(size):
    draw = np.random.default_rng(1)
    vectors = draw.integers(-size, size + 1, (50, 6))
    ids, scores = np.arange(50), vectors @ vectors.T
    q, v, s = tile_top(ids[:5], vectors[:5], ids, vectors, 3)
    for query in range(5):
        order = [n for n in sorted(range(50), key=lambda n: (-scores[query, n], n)) if n != query][:3]
        assert sorted(v[q == query].tolist()) == sorted(order) and sorted(s[q == query]) == sorted(scores[query, order])
