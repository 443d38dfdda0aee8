import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapweave.llm.binary import binary_round_trip, read_ids, write_ids
from snapweave.llm.files import read_array
from snapweave.llm.packing import pack_documents, pack_lengths, places
from snapweave.llm.tokens import WordCache, text_groups
from snapweave.runtime import scratch_path

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "a  b", "a\n\nb\n", " x", "x ", "It's o'clock, don't!! 'tis", "a1b2 3.5", "Éa͡ ñ́", "x y", "Σας ΣΑΣ. İx",
    "a\tb", "tok </w> <|endoftext|> x", "word​z", "ǅ ﬁ", "é. x", "...", "\n", "x.,y", "a , b . c", "a ,b", ",", ", x",
    "x", "a \rb", "a\r\nb", "The the THE, the. The", "漢字 かな, 한국어.", "x\x1cy z", "end.\nNext, line.\n",
]


def library(name, special=True):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = special
    return found


@pytest.mark.parametrize("name", VOCABULARIES)
def test_cached_ids_are_the_library_s(name):
    cache, reference = WordCache(public_tokenizers.path(name), cached_words=5), library(name)
    random.seed(5)
    mixed = ["".join(random.choice("aB é,.\n'1 \t!") for _ in range(random.randint(0, 40))) for _ in range(1500)]
    for texts in (TEXTS, mixed, TEXTS):
        for text, ids in zip(texts, cache.encode(texts), strict=True):
            assert reference.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_text_groups_keep_everything():
    assert [x for g in text_groups(["a" * 5, None, "b" * 9, "", "c"], 6) for x in g] == ["a" * 5, "", "b" * 9, "", "c"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    random.seed(seed)
    draw = [lambda: random.randint(1, 64), lambda: random.choice([21, 22, 43, 64]), lambda: min(64, 1 + int(random.expovariate(0.1))), lambda: 40]
    counts = collections.Counter(draw[seed]() for _ in range(3000))
    runs = pack_lengths(counts, 64, groups=12)
    assert all(r.count > 0 and r.room >= 0 and r.room + sum(n * e for n, _, e in r.content) == 64 for r in runs)
    taken = collections.defaultdict(list)
    for length, first, last, *_ in places(runs):
        taken[length].append((first, last))
    for length, parts in taken.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == counts[length] - 1
        assert all(b[0] == a[1] + 1 for a, b in zip(parts, parts[1:]))


def test_plan_is_near_the_least_possible():
    random.seed(1)
    counts = collections.Counter(random.randint(1, 1024) for _ in range(40_000))
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(r.count for r in pack_lengths(counts, 1024)) <= least * 1.005
    # 100 sequences of three times 341, 100 of 500 + 500 + 24, and 100 times 24 more: 203, the least by volume.
    assert sum(r.count for r in pack_lengths({341: 300, 500: 200, 24: 200}, 1024)) == 203
    assert pack_lengths({}, 1024) == []
    with pytest.raises(ValueError):
        pack_lengths({1025: 1}, 1024)


def check_packing(rows, docs, capacity=1024):
    reference = library("byte_bpe_50k.json")
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for number, text, *_ in docs:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((number, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert got == want
    full = collections.defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(full)


def test_packing_of_awkward_documents(spark, awkward):
    from llm_cases import AWKWARD

    rows = pack_documents(spark, awkward, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(rows, AWKWARD)


def test_packing_of_nothing(spark, nothing):
    assert pack_documents(spark, nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_files_round_trip(spark, awkward, nothing):
    from llm_cases import AWKWARD

    path = public_tokenizers.path("word_bpe_49k.json")
    reference = library("word_bpe_49k.json")
    rows = sorted(binary_round_trip(spark, awkward, path).collect(), key=lambda r: r.start)
    numbers = [r.doc_id for r in rows]
    assert numbers == sorted((d[0] for d in AWKWARD), key=lambda x: (x is not None, x))
    at, sums = 0, collections.Counter()
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        sums[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    want = collections.Counter()
    for number, text, *_ in AWKWARD:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[number, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert sums == want
    assert binary_round_trip(spark, nothing, path).count() == 0


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_flat_files_are_one_sequence(spark, table_of, kind):
    docs = table_of([(i, f"text number {i} " * (i % 7), "en", "s", 0) for i in range(200)]).repartition(6)
    folder = scratch_path(spark, "ids")
    shards = write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2, kind)
    reference = library("word_bpe_49k.json")
    flat = [x for i in range(200) for x in [*reference.encode(f"text number {i} " * (i % 7), add_special_tokens=False).ids, 2]]
    got = [x for s in shards.orderBy("base").collect() for x in read_array(f"{folder}/{s.shard}.ids", kind).tolist()]
    assert got == flat
    assert read_ids(shards, folder, kind).count() == 200
