"""New words reach the library many at a time, and their ids are cut apart again where words end."""

import random

import public_tokenizers
import pytest

from snapweave.llm.tokens import FIRST, JOINED_BYTES, MARK, WordCache

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def invented(n, seed):
    random.seed(seed)
    parts = ["th", "er", "ón", "Ä", "ß", "que", "ı", "Œu", "ing", "é"]
    return list(dict.fromkeys("".join(random.choices(parts, k=random.randint(4, 9))) for _ in range(n)))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_many_new_words_are_few_texts_for_the_library(name):
    cache = WordCache(public_tokenizers.path(name))
    asked = []
    whole = cache._whole
    cache._whole = lambda texts: asked.extend(texts) or whole(texts)
    words = invented(3000, 3)
    texts = [" ".join(f"{w}###" for w in words), "\n".join(f"{w}." for w in reversed(words))]
    want = [x.ids for x in cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in cache.encode(texts)] == want
    assert len(asked) < 20
    assert [ids.tolist() for ids in cache.encode(texts)] == want and len(asked) < 20


@pytest.mark.parametrize("name", VOCABULARIES)
def test_words_at_every_kind_of_border(name):
    cache = WordCache(public_tokenizers.path(name), cached_words=60)
    long = "ab" * JOINED_BYTES
    texts = [
        "", long, f"{long}, {long}\nx", "It's&& o'clock'. (word)\"] a_b_ x--\ny", "H̱ H, İx. ĀA! ŉ ª º µ",
        "a̸ ≮ x=", f"x {MARK} y", f"{FIRST}x", "end!", "\nEnd?", " ?", "a!\n\nb!", "é;\tè;", "",
    ]
    texts += [" ".join(invented(9, n)) for n in range(40)]
    want = [x.ids for x in cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in cache.encode(texts)] == want
    assert [cache.encode([t])[0].tolist() for t in texts] == want
