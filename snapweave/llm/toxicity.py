"""Toxicity by a weighted grammar of finite-state transducers over clauses.

1. Words become symbols: insult, threat, target, negation, reported speech, quotation mark, clause end,
   line end, other. Function words are fixed lists; insults are word stems with weights learned
   from labels (plus a short list that holds without any), so every language of the corpus gets its own.
2. Three transducers read the symbols one after the other: negation (an insult within reach of a
   negation is denied), reported speech (said or quoted by someone), target (an insult near the person
   it is meant for; a threat counts only with one). They are composed into one deterministic machine.
3. Events of a clause are added up, weighted by their stems; a document is scored by logistic
   regression on the sums of its matched clauses. Its weights start from a prior and are fitted to labels.

Stems and weights are fitted on a sample of at most ``most`` labelled documents of each class; near
copies in it count once. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapweave.runtime import materialize

MOST = 20_000  # labelled documents of each class that stems and weights are fitted on
MOST_STEMS = 50_000
REACH = 4  # words over which a negation or a target works
KNOWN_WORDS = 300_000  # words whose symbol a task remembers

# --- symbols ---------------------------------------------------------------------------------

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, LINE = range(9)
SYMBOLS = range(9)
# What the machine says about an insult or a threat.
DIRECT, AIMED, MENACE, SAID, DENIED = range(1, 6)
KINDS = 5

# Function words of the grammar, by language (English, German, French, Spanish).
NEGATIONS = (
    "not no never nobody nothing without cannot",
    "nicht nie niemals kein keine keinen keiner ohne",
    "pas jamais aucun aucune sans",
    "nunca jamás ningún ninguna sin",
)
REPORTS = (
    "said says called calls wrote writes quoted claims claimed alleged according",
    "sagte sagt schrieb nannte nennt laut angeblich",
    "dit disait écrit appelé selon",
    "dijo dice escribió llamó según",
)
TARGETS = (
    "you your you're yourself they them their he him his she her",
    "du dich dir dein ihr euch",
    "tu toi ton vous votre ils eux",
    "tú usted ustedes vosotros ellos",
)
THREATS = (
    "kill hurt destroy burn beat shoot stab",
    "töten umbringen schlagen vernichten",
    "tuer frapper brûler détruire",
    "matar golpear quemar destruir",
)
INSULTS = (
    "clown disgusting idiot loser moron pathetic scum stupid trash worthless",
    "dumm dummkopf widerlich wertlos",
    "crétin débile imbécile minable",
    "asqueroso estúpido idiota imbécil",
)
SEED_WEIGHT = 2.0

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;\n\"“”„«»]")
MARKS = dict.fromkeys(".!?;", END) | {"\n": LINE} | dict.fromkeys('"“”„«»', QUOTE)


def _listed() -> dict[str, int]:
    words: dict[str, int] = {}
    for symbol, lists in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)):
        words |= dict.fromkeys(" ".join(lists).split(), symbol)
    return words | MARKS


# --- transducers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic, one output per input: ``moves[state, symbol] = (next state, output)``."""

    start: object
    moves: dict

    def then(self, other: Transducer) -> Transducer:
        """This one's output read by ``other``: the product of the states that can be reached."""
        start = (self.start, other.start)
        moves, todo = {}, [start]
        symbols = {symbol for _, symbol in self.moves}
        seen = {start}
        while todo:
            a, b = todo.pop()
            for symbol in symbols:
                next_a, middle = self.moves[a, symbol]
                next_b, out = other.moves[b, middle]
                moves[(a, b), symbol] = ((next_a, next_b), out)
                if (next_a, next_b) not in seen:
                    seen.add((next_a, next_b))
                    todo.append((next_a, next_b))
        return Transducer(start, moves)


# Marks between the transducers: an insult or a threat that is denied or reported.
NOT_MEANT, TOLD = 9, 10


def negation() -> Transducer:
    """Within ``REACH`` words of a negation in its clause, insults and threats are denied."""
    moves = {}
    for left in range(REACH + 1):
        for s in SYMBOLS:
            step = max(left - 1, 0)
            if s == NEGATION:
                moves[left, s] = (REACH, OTHER)
            elif s in (END, LINE):
                moves[left, s] = (0, s)
            elif s == QUOTE:
                moves[left, s] = (left, s)
            else:
                moves[left, s] = (step, NOT_MEANT if left and s in (INSULT, THREAT) else s)
    return Transducer(0, moves)


def reported_speech() -> Transducer:
    """After a verb of saying, to the end of the clause, and between quotation marks, to the end of the line."""
    moves = {}
    for said in (False, True):
        for quoted in (False, True):
            for s in [*SYMBOLS, NOT_MEANT]:
                state = {
                    REPORT: (True, quoted),
                    QUOTE: (said, not quoted),
                    END: (False, quoted),
                    LINE: (False, False),
                }.get(s, (said, quoted))
                out = TOLD if s in (INSULT, THREAT) and (said or quoted) else OTHER if s in (REPORT, QUOTE) else s
                moves[(said, quoted), s] = (state, out)
    return Transducer((False, False), moves)


def target() -> Transducer:
    """An insult with its target within ``REACH`` words before or behind is aimed; a threat counts only so."""
    moves = {}
    for person in range(REACH + 1):  # words for which a target named before still counts
        for open_threat in range(REACH + 1):  # words within which a target makes a threat of the verb before
            for s in [OTHER, INSULT, THREAT, TARGET, END, LINE, NOT_MEANT, TOLD]:
                p, t = max(person - 1, 0), max(open_threat - 1, 0)
                out = 0
                if s in (END, LINE):
                    p = t = 0
                elif s == INSULT:
                    out = AIMED if person else DIRECT
                elif s == THREAT:
                    t = REACH
                elif s == TARGET:
                    out = MENACE if open_threat else 0
                    p, t = REACH, 0
                elif s == NOT_MEANT:
                    out = DENIED
                elif s == TOLD:
                    out = SAID
                moves[(person, open_threat), s] = ((p, t), out)
    return Transducer((0, 0), moves)


def machine() -> tuple[np.ndarray, np.ndarray]:
    """The three composed: next state and event by (state, symbol); state 0 is the start."""
    whole = negation().then(reported_speech()).then(target())
    states = {whole.start: 0}
    for state, _ in whole.moves:
        states.setdefault(state, len(states))
    step = np.zeros((len(states), len(SYMBOLS)), np.int32)
    event = np.zeros_like(step)
    for (state, symbol), (following, out) in whole.moves.items():
        step[states[state], symbol] = states[following]
        event[states[state], symbol] = out
    return step, event


# --- grammar with its lexicon -------------------------------------------------------------------


def stems_of(word: str) -> list[str]:
    """The whole word (``=word``) and its beginnings of 3 to 8 letters."""
    return ["=" + word] + [word[:n] for n in range(3, min(9, len(word)))]


@dataclass
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] | None = None


# log(1 + weight of direct, aimed, threatening, reported, denied), of the strongest clause, matched clauses, words; bias.
PRIOR = np.array([1.5, 1.8, 1.8, 0.3, 0.1, 0.5, 0.5, -0.3, -2.0])


class Words(dict):
    """Symbol of a token and its weight as one number: symbol + 16 * place in the list of weights."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        listed = _listed()
        self.weights = [SEED_WEIGHT]  # of threats
        self.stems = {}
        seeds = {"=" + w: SEED_WEIGHT for w in " ".join(INSULTS).split()}
        for stem, weight in (seeds | stems).items():
            self.stems[stem] = len(self.weights)
            self.weights.append(weight)
        self.update(listed)
        self.listed = listed
        self.weights = np.array(self.weights)

    def __missing__(self, token: str) -> int:
        if token.endswith(("n't", "n’t")):
            found = NEGATION
        else:
            at = [self.stems[s] for s in stems_of(token) if s in self.stems]
            best = max(at, key=self.weights.__getitem__, default=0)
            found = INSULT + 16 * best if best and self.weights[best] > 0 else OTHER
        if len(self) < KNOWN_WORDS:
            self[token] = found
        return found


class Scorer:
    def __init__(self, grammar: Grammar):
        self.words = Words(grammar.stems)
        step, event = machine()
        self.step, self.event = step.tolist(), event.tolist()
        # Where a run of other words leads: beyond REACH words nothing changes any more.
        idle = np.arange(len(step))
        self.idle = [idle.tolist()]
        for _ in range(REACH):
            idle = step[idle, OTHER]
            self.idle.append(idle.tolist())
        self.weights = np.array(grammar.weights) if grammar.weights else PRIOR

    def clauses(self, text: str | None) -> tuple[list[list[float]], int]:
        """Weights by kind of every clause with an event, and the number of words."""
        tokens = TOKEN.findall((text or "").lower())
        codes = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        symbols = codes & 15
        n_words = int(np.count_nonzero(symbols < QUOTE))
        if not np.any((symbols == INSULT) | (symbols == THREAT)):
            return [], n_words
        places = np.flatnonzero(symbols)
        gaps = np.minimum(np.diff(places, prepend=-1) - 1, REACH).tolist()
        weights = self.words.weights[codes[places] >> 4].tolist()
        out: list[list[float]] = []
        state, clause, last = 0, None, 0.0
        for gap, symbol, weight in zip(gaps, symbols[places].tolist(), weights):
            state = self.idle[gap][state]
            event = self.event[state][symbol]
            state = self.step[state][symbol]
            if event:
                if clause is None:
                    clause = [0.0] * KINDS
                    out.append(clause)
                clause[event - 1] += weight
            elif symbol >= END:
                clause = None
        return out, n_words

    def features(self, text: str | None) -> np.ndarray:
        found, n_words = self.clauses(text)
        sums = np.array(found).sum(0) if found else np.zeros(KINDS)
        strongest = max((sum(c[:3]) for c in found), default=0.0)
        return np.concatenate([np.log1p(sums), [np.log1p(strongest), np.log1p(len(found)), np.log1p(n_words), 1.0]])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.features(text) @ self.weights)))))


# --- learning ----------------------------------------------------------------------------------------


def hash_part(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _copy_key(tokens: list[str]) -> int:
    """The least hash of five words in a row: near copies mostly share it."""
    joined = [" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))]
    return min(zlib.crc32(x.encode()) for x in joined)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``toxic, part, text`` of about ``most`` documents of each class, drawn by hash; near copies once.

    ``labels`` holds the rows that may be learned from. Only their ids meet the documents, and those
    are at most some ``2 * most``.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labelled")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, most / n))) for k, n in counts.items()], F.lit(1.0))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < share * 1_000_000
    asked = F.broadcast(known.filter(drawn))  # about 2 * most rows

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_copy_key(TOKEN.findall((t or "").lower())) for t in batch.column("text").to_pylist()]
            yield batch.append_column("copy_key", pa.array(own, pa.int64()))

    met = docs.select("doc_id", "text").join(asked, "doc_id").select("doc_id", "toxic", "text")
    keyed = met.mapInArrow(keys, "doc_id bigint, toxic int, text string, copy_key bigint")
    once = keyed.groupBy("copy_key", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("d"))
    once = once.withColumn("d_id", F.col("d.doc_id"))
    once = once.groupBy("d_id").agg(F.min(F.struct("toxic", "d")).alias("x"))  # a repeated doc_id counts once
    part = F.pmod(F.xxhash64("d_id", F.lit(29)), F.lit(3))
    return materialize(once.select(F.col("x.toxic").alias("toxic"), part.alias("part"), F.col("x.d.text").alias("text")), "sample")


def specific_stems(found: dict[str, tuple[float, int]], share: float = 0.8) -> dict[str, float]:
    """Without beginnings of words that stand for hardly more than one longer stem: those say nothing of other words."""
    most: dict[str, int] = {}
    for stem, (_, n) in found.items():
        whole = stem.startswith("=")
        word = stem[1:] if whole else stem
        for end in range(3, len(word) + whole):
            most[word[:end]] = max(most.get(word[:end], 0), n)
    return {s: w for s, (w, n) in found.items() if s.startswith("=") or most.get(s, 0) < share * n}


def learn_stems(sample: DataFrame, surety: float = 2.0, least: float = 1.0) -> dict[str, float]:
    """Stems that toxic documents hold more often: the lower bound of their log odds, ``surety`` deviations down."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _listed()
        for batch in batches:
            seen: Counter = Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = {w for w in TOKEN.findall((text or "").lower()) if w not in listed and len(w) > 2}
                seen.update((s, toxic) for s in {s for w in words for s in stems_of(w)})
            if seen:
                keys, n = zip(*seen.items())
                stems, toxic = zip(*keys)
                yield pa.RecordBatch.from_arrays([pa.array(stems), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], names=["stem", "toxic", "n"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return {}
    held = sample.mapInArrow(count, "stem string, toxic int, n bigint").groupBy("stem").agg(
        *[F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)]
    )
    bad, good = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(bad / (totals[1] + 1)) - F.log(good / (totals[0] + 1))
    weight = odds - surety * F.sqrt(1 / bad + 1 / good)
    listed = {"=" + w for w in " ".join(INSULTS).split()}
    # A stem of the fixed list is taken as learned, even if not toxic here, once enough documents hold it.
    seeds = held.filter(F.col("stem").isin(*listed) & (F.col("n0") + F.col("n1") >= 10)).withColumn("weight", weight)
    found = held.withColumn("weight", weight).filter(F.col("weight") >= least).orderBy(F.desc("weight"), "stem").limit(MOST_STEMS)
    rows = found.unionByName(seeds).select("stem", "weight", "n1").collect()
    return specific_stems({r["stem"]: (float(r["weight"]), r["n1"]) for r in rows})


def fit_weights(features: np.ndarray, toxic: np.ndarray, rounds: int = 30, hold: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps, pulled towards ``PRIOR``."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (p - toxic) + hold * (w - PRIOR)
        curve = (features * (p * (1 - p))[:, None]).T @ features + hold * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(grammar: Grammar, docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grammar)
        for batch in batches:
            rows = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "features"])

    return docs.select("toxic", "text").mapInArrow(run, "toxic int, features array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Grammar:
    """Weights are fitted on a third of the sample with stems from the other two, so that stems are not judged where
    they were found; then stems are learned from all of it. Without labels of both classes the fixed words and the
    prior stand."""
    sample = labelled_sample(docs, labels, most)
    grammar = Grammar(learn_stems(sample.filter("part < 2")))
    rows = _features(grammar, sample.filter("part = 2")).collect()  # at most some 2 * most / 3 short rows
    toxic = np.array([r["toxic"] for r in rows], float)
    if len(rows) and 0 < toxic.sum() < len(rows):
        grammar.weights = fit_weights(np.array([r["features"] for r in rows]), toxic).tolist()
        grammar.stems = learn_stems(sample)
    return grammar


# --- scoring ------------------------------------------------------------------------------------------


def score_texts(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score`` of every row; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most MOST_STEMS short texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def judge_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out quarter.

    Null and empty texts have no clause and the score of an empty text. A row without ``doc_id`` is not held
    out and never learned from. Repeated rows are scored each; of contradicting labels the toxic one counts.
    Other columns are ignored. An empty table has no rows.
    """
    mine = labels.filter(hash_part(F.col("doc_id"), 4) != 2)
    scored = score_texts(docs, train(docs, mine))
    held_out = F.coalesce(hash_part(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
