"""Token ids of whole texts with the ``tokenizers`` library, each distinct word encoded once per task.

Byte-pair merges never cross a pre-token, so the ids of a text are the ids of its pre-tokens
one after the other. Words repeat; ``WordCache`` asks the library only for those it
does not hold and looks the others up. Arrow cuts many texts at once and finds their distinct words. Texts whose white space could be cut in more than
one way go to the library whole.
"""

from __future__ import annotations

import json
import os
import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from snapweave.llm.rows import give_back

# Words kept per worker, some 200 bytes each, in two generations: when the newer one holds half of
# them it becomes the older one, and what was not used since the last change goes.
CACHED_WORDS = 1000000
# After its last task a worker keeps them for so many seconds, for the next task of the same stage.
IDLE_SECONDS = 3.0


def _byte_letters() -> dict[int, str]:
    """The letter that stands for a byte in byte-level vocabularies: itself if printable, else the next one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


# Marks in front of a key; a text that holds one goes to the library whole.
MARK, FIRST = "\ue000", "\ue001"
# Letters up to U+017F without U+0130, whose small letter is two; punctuation that ends a word after a letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u017f"
APART = rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~]+)([ \n]|\z)"
JOINED_BYTES = 60_000  # of new words that the library gets as one text


def _large(text: str | None) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _matching(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(words, pattern), False).to_numpy(zero_copy_only=False)


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each has."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


def _gathered(flat: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at these places one after the other, and how many each has."""
    begins = starts[places]
    lengths = starts[places + 1] - begins
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - ends + lengths, lengths) + np.arange(total)], lengths


def _shelf() -> dict:
    """What a process keeps between tasks. The package travels with every task by value, and reading a task sets the
    variables of its classes anew; a module of the process stays as it is and never travels."""
    return vars(sys.modules.setdefault("_snapweave_shelf", ModuleType("_snapweave_shelf")))


class _Lender(type):
    @property
    def _kept(cls) -> tuple[str, WordCache] | None:
        return _shelf().get("cache")


class WordCache(metaclass=_Lender):
    """Ids of texts by one vocabulary file. Special-token strings inside a text are ordinary text.

    A text is cut at its spaces and line breaks, and before punctuation (but an apostrophe) that follows a
    letter and ends a word. Where white space counts (no word-end marker in the vocabulary), a key
    stands for the word with the space before it; with a line break in front for the break and the
    word; with ``FIRST`` for the word that starts a text; with ``MARK`` for what was cut off a word.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit = cached_words
        with open(path, encoding="utf-8") as file:
            self.drops_space = bool(json.load(file)["model"].get("end_of_word_suffix"))
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab()
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or start one after a space
        self.border[[n for t, n in vocabulary.items() if (t.endswith("</w>") if self.drops_space else t.startswith(letters[32]))]] = True
        self.line_break = vocabulary.get(letters[10], -1)
        self._reset()

    @classmethod
    @contextmanager
    def lent(cls, path: str) -> Iterator[WordCache]:
        """The worker's cache for a vocabulary; freed when no task has asked for it within ``IDLE_SECONDS``."""
        shelf = _shelf()
        timer = shelf.pop("timer", None)
        if timer is not None:
            timer.cancel()
        kept = shelf.pop("cache", None)
        cache = kept[1] if kept is not None and kept[0] == path else cls(path)
        del kept
        try:
            yield cache
        finally:
            shelf["cache"] = path, cache
            shelf["timer"] = threading.Timer(IDLE_SECONDS, cls.free)
            shelf["timer"].daemon = True
            shelf["timer"].start()

    @classmethod
    def free(cls) -> None:
        if _shelf().pop("cache", None) is not None:
            give_back()

    def _reset(self) -> None:
        self.older: tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray] = ({}, np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool))
        self._begin()

    def _begin(self) -> None:
        """An empty newer generation."""
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.odd = np.zeros(0, bool)  # keys with white space that can be cut in more than one way

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """Ids of words that the newer generation lacks: from the older one, else from the library."""
        place, flat, starts, odd = self.older
        known = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
        kept, fresh = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        if len(kept):
            self._append([words[i] for i in kept.tolist()], *_gathered(flat, starts, known[kept]), odd[known[kept]])
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            self._append(new, *self._encoded(pa.array(new, pa.large_string())))

    def _append(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, odd: np.ndarray) -> None:
        first = len(self.odd)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.odd = np.concatenate([self.odd, odd])

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words one after the other, how many each has, and which words are odd. Words of letters up to U+017F
        are one pre-token and need no normal form but lower case: the library gets many of them as one text."""
        odd = np.zeros(len(words), bool)
        plain = _matching(words, rf"\A[{LETTERS}]+\z")
        parts = list(self._joined(words, np.flatnonzero(plain), " "))
        if not self.drops_space:
            led = _matching(words, rf"\A[\n{FIRST}{MARK}][{LETTERS}]+\z")
            bare = led & ~_matching(words, r"\A\n")
            parts += self._joined(pc.utf8_slice_codeunits(words, 1), np.flatnonzero(led), "\n", bare)
            plain |= led
        rest: list[tuple[int, str]] = []
        for i, word in zip(np.flatnonzero(~plain).tolist(), _strings(words.filter(pa.array(~plain))), strict=True):
            if self.drops_space:
                rest.append((i, word))
                continue
            head = word[:1]
            body = word[1:] if head in ("\n", FIRST, MARK) else word
            if not body or len(body.split()) > 1 or body != body.strip():
                odd[i] = True
            rest.append((i, "" if odd[i] else body if head in (FIRST, MARK) else word if head == "\n" else " " + word))
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            parts.append((np.array([i for i, _ in some]), *_flat(self._whole([text for _, text in some]))))
        order = np.argsort(np.concatenate([at for at, _, _ in parts]))
        starts = np.concatenate([[0], np.cumsum(np.concatenate([lengths for _, _, lengths in parts]))])
        return *_gathered(np.concatenate([ids for _, ids, _ in parts]), starts, order), odd

    def _joined(self, words: pa.Array, at: np.ndarray, lead: str, bare: np.ndarray | None = None):
        """The words at these places, encoded as one text with ``lead`` before each and cut where the ids show it: places,
        ids, number of ids of each. ``bare`` words go without the id of their lead."""
        words = words.take(pa.array(at))
        sizes = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = [0, *(np.flatnonzero(np.diff(sizes // JOINED_BYTES)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            some = _strings(words[a:b])
            ids, _ = _flat(self._whole([lead + lead.join(some)]))
            if self.drops_space:
                firsts = np.concatenate([[0], np.flatnonzero(self.border[ids]) + 1])[:-1]
            else:
                firsts = np.flatnonzero(self.border[ids] if lead == " " else ids == self.line_break)
            lengths = np.diff(np.append(firsts, len(ids)))
            if len(firsts) != b - a or firsts[0] or (self.drops_space and not self.border[ids[-1]]):  # a vocabulary that does not show where words begin
                ids, lengths = _flat(self._whole([lead + x for x in some]))
                firsts = np.cumsum(lengths) - lengths
            if bare is not None:
                ids = np.delete(ids, firsts[bare[at[a:b]]])
                lengths = lengths - bare[at[a:b]]
            yield at[a:b], ids, lengths

    def _keys(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, set[int]]:
        """Keys of the words of all texts, the first key of each text, and the texts that hold a mark (they get no keys)."""
        rows = pa.array([text or None for text in texts], pa.large_string())
        marked: set[int] = set()
        if self.drops_space:
            # A capital may meet a following mark in another way than its small letter does.
            rows = pc.if_else(pa.array(_matching(rows, r"[\x{300}-\x{10FFFF}]")), rows, pc.ascii_lower(rows))
            rows = pc.replace_substring_regex(rows, APART, r"\1 \2\3")
            rows = pc.replace_substring(rows, "\n", " ")
        else:
            holds = _matching(rows, f"[{MARK}{FIRST}]")
            marked.update(np.flatnonzero(holds).tolist())
            rows = pc.if_else(pa.array(holds), _large(None), rows)
            rows = pc.replace_substring_regex(rows, APART, rf"\1 {MARK}\2\3")
            rows = pc.replace_substring(rows, "\n", " \n")
            rows = pc.binary_join_element_wise(_large(FIRST), rows, _large(""))
        split = pc.split_pattern(rows, " ")
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        return split.flatten(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), marked

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; an empty text has none."""
        if len(self.place) > self.limit // 2:
            self.older = self.place, self.flat, self.starts, self.odd
            self._begin()
        keys, cuts, whole = self._keys(texts)
        keys = keys.dictionary_encode()
        distinct, which = _strings(keys.dictionary), keys.indices.to_numpy()
        places = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            words = [distinct[i] for i in missing]
            self._add(words)
            places[missing] = list(map(self.place.__getitem__, words))
        odd = np.flatnonzero(self.odd[places][which]) if self.odd[places].any() else np.zeros(0, np.int64)
        whole.update((np.searchsorted(cuts, odd, "right") - 1).tolist())
        ids, lengths = _gathered(self.flat, self.starts, places[which])
        borders = np.concatenate([[0], np.cumsum(lengths)])[cuts]
        out = [ids[borders[i] : borders[i + 1]] for i in range(len(texts))]
        asked = sorted(whole)
        for i, found in zip(asked, self._whole([texts[i] for i in asked]) if asked else [], strict=True):
            out[i] = np.array(found, np.uint32)
        return out


def text_groups(texts: list[str | None], most_chars: int = 4_000_000):
    """Runs of texts (null as empty) of at most so many characters, or one longer text: what is encoded at once."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > most_chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
