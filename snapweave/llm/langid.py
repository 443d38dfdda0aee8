"""Language ID with a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads UTF-8 bytes in both directions, in windows of ``WINDOW`` bytes, and gives
every position a probability for each language; a document's probabilities are the mean over
all its positions. Windows make whole texts of any length a batch of equal rows; the last one
of a text ends at its end, and positions read before do not count twice.

Training is backpropagation through time with Adam, on the driver, over a bounded sample: at
most ``docs_per_lang`` documents per language (those with the smallest hashes, so the choice
does not depend on order or partitions), ``windows_per_doc`` windows from all over each text.
Only text and label of documents outside the held-out fold are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from snapweave.llm.rows import released

WINDOW, HIDDEN = 64, 8
DOCS_PER_LANG, WINDOWS_PER_DOC = 500, 4
# Documents taken in all; with many languages each gets fewer, but at least LEAST_DOCS.
MOST_DOCS, LEAST_DOCS, MOST_LANGS = 32_000, 20, 1_000
STEPS, BATCH, RATE = 300, 192, 0.02
CHUNK = 2048  # windows read at once
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: input table ``E``, recurrent matrix ``U`` and offset ``c`` (update, reset, candidate); output ``V, v``."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, size: draw.normal(0, size, shape).astype(np.float32)
        weights = {}
        for d in "fb":
            weights["E" + d] = normal(3 * hidden, 256, size=0.3)
            weights["U" + d] = normal(3 * hidden, hidden, size=0.5 / hidden**0.5)
            weights["c" + d] = np.zeros((3 * hidden, 1), np.float32)
        weights["V"] = normal(len(langs), 2 * hidden, size=0.3)
        weights["v"] = np.zeros((len(langs), 1), np.float32)
        return cls(langs, weights)

    def _read(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each position, ``x`` being (position, window); ``keep`` collects what training needs."""
        table, matrix = self.weights["E" + d] + self.weights["c" + d], self.weights["U" + d].copy()
        hidden = matrix.shape[1]
        # A gate is 1 / (1 + exp(-a)) = (1 + tanh(a / 2)) / 2.
        table[: 2 * hidden] *= 0.5
        matrix[: 2 * hidden] *= 0.5
        x = x.astype(np.intp)
        state = np.zeros((hidden, x.shape[1]), np.float32)
        out = np.empty((len(x), hidden, x.shape[1]), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = np.take(table, x[t], axis=1, mode="clip")
            u = matrix @ state
            gates = a[: 2 * hidden]
            gates += u[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:hidden], gates[hidden:]
            n = a[2 * hidden :]
            n += r * u[2 * hidden :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, state, z, r, n, u[2 * hidden :]))
            state = state - n
            state *= z
            state += n
            out[t] = state
        return out

    def _label(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Probabilities (position, language, window)."""
        hidden = forward.shape[1]
        scores = self.weights["V"][:, :hidden] @ forward
        scores += self.weights["V"][:, hidden:] @ backward
        scores += self.weights["v"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def label_positions(self, x: np.ndarray) -> np.ndarray:
        return self._label(self._read(x, "f"), self._read(x, "b"))

    def _unread(self, x: np.ndarray, d: str, kept: list, above: np.ndarray, grads: dict) -> None:
        """Backpropagation through time of one direction."""
        matrix = self.weights["U" + d]
        hidden = matrix.shape[1]
        flow = np.zeros_like(above[0])
        inputs = np.empty((len(x), 3 * hidden, x.shape[1]), np.float32)
        change = np.zeros_like(matrix)
        for t, before, z, r, n, u in reversed(kept):
            flow = flow + above[t]
            into_n = flow * (1 - z) * (1 - n * n)
            into_z = flow * (before - n) * z * (1 - z)
            into_r = into_n * u * r * (1 - r)
            inputs[t] = np.concatenate([into_z, into_r, into_n])
            recurrent = np.concatenate([into_z, into_r, into_n * r])
            change += recurrent @ before.T
            flow = flow * z + matrix.T @ recurrent
        flat = inputs.transpose(1, 0, 2).reshape(3 * hidden, -1)
        one_hot = np.zeros((x.size, 256), np.float32)
        one_hot[np.arange(x.size), x.ravel()] = 1
        grads["E" + d], grads["U" + d], grads["c" + d] = flat @ one_hot, change, flat.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients. ``y``: the language of each window."""
        kept_f: list = []
        kept_b: list = []
        forward, backward = self._read(x, "f", kept_f), self._read(x, "b", kept_b)
        found = self._label(forward, backward)
        column = np.arange(x.shape[1])
        loss = -float(np.log(found[:, y, column] + 1e-9).mean())
        wrong = found
        wrong[:, y, column] -= 1
        wrong /= x.size
        hidden = forward.shape[1]
        v = self.weights["V"]
        grads = {
            "V": np.concatenate([np.einsum("tcb,thb->ch", wrong, s, optimize=True) for s in (forward, backward)], axis=1),
            "v": wrong.sum(axis=(0, 2))[:, None],
        }
        self._unread(x, "f", kept_f, v[:, :hidden].T @ wrong, grads)
        self._unread(x, "b", kept_b, v[:, hidden:].T @ wrong, grads)
        return loss, grads

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> list[float]:
        """Adam over batches with as many windows of each language; the rate falls to zero."""
        draw = np.random.default_rng(seed)
        by_lang = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            share = max(1, batch // len(by_lang))
            some = np.concatenate([draw.choice(own, share) for own in by_lang])
            loss, grads = self.gradients(np.ascontiguousarray(windows[some].T), labels[some])
            size = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step_size = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * step_size).astype(np.float32)
            losses.append(loss)
        return losses

    def document_probabilities(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each text ``data[start:end]``; texts must not be empty."""
        lengths = ends - starts
        counts = -(-lengths // WINDOW)
        doc = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        plain = nth * WINDOW
        begin = np.minimum(plain, np.maximum(lengths[doc] - WINDOW, 0))
        total = np.zeros((len(starts), len(self.langs)))
        for at in range(0, len(doc), CHUNK):
            d = doc[at : at + CHUNK]
            inside = begin[at : at + CHUNK][None, :] + np.arange(WINDOW)[:, None]
            place = np.minimum(starts[d] + inside, len(data) - 1)
            x = np.where(inside < lengths[d], data[place], 32)
            counted = (inside >= plain[at : at + CHUNK]) & (inside < lengths[d])
            found = self.label_positions(x)
            np.add.at(total, d, np.einsum("tcb,tb->bc", found, counted.astype(np.float32), optimize=True))
        return total / lengths[:, None]


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the number as text leaves that remainder; rows without a number are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _cut_windows(count: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                last = max(0, len(data) - WINDOW)
                begins = sorted({last * k // max(1, count - 1) for k in range(count)})
                windows.append([data[b : b + WINDOW].ljust(WINDOW, b" ") for b in begins])
            kept = [batch.column("lang"), batch.column("hash"), pa.array(windows, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(kept, names=["lang", "hash", "windows"])

    return cut


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, steps: int = STEPS) -> Network | None:
    """A network for the languages of the rows outside the held-out fold: all, or the ``MOST_LANGS`` with most documents.

    None if no row has a label and a letter.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & _has_letter())
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return None
    docs_per_lang = min(docs_per_lang, max(LEAST_DOCS, MOST_DOCS // len(counts)))
    # The hash of the last document taken, per language. Only hashes move, and of a frequent language only so many of the
    # smallest that there are surely enough.
    top = F.lit(None).cast("double")
    for row in counts:
        top = F.when(F.col("lang") == row["lang"], F.lit(-(2.0**63) + 2.0**64 * min(1.0, 8 * docs_per_lang / row["docs"]))).otherwise(top)
    hashes = usable.select("lang", "hash").where(F.col("hash").cast("double") <= top).distinct()
    ranked = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    found = ranked.where(F.col("n") <= docs_per_lang).groupBy("lang").agg(F.max("hash").alias("border")).collect()
    border = F.lit(None).cast("long")
    for row in found:
        border = F.when(F.col("lang") == row["lang"], F.lit(row["border"])).otherwise(border)
    cut = usable.where(F.col("hash") <= border).mapInArrow(released(_cut_windows(WINDOWS_PER_DOC)), "lang string, hash bigint, windows array<binary>")
    # At most MOST_DOCS * WINDOWS_PER_DOC windows come to the driver, repeated rows once.
    rows = sorted(cut.dropDuplicates(["lang", "hash"]).collect(), key=lambda r: (r["lang"], r["hash"]))
    langs = sorted(r["lang"] for r in found)
    windows = np.array([np.frombuffer(w, np.uint8) for r in rows for w in r["windows"]])
    labels = np.array([langs.index(r["lang"]) for r in rows for _ in r["windows"]])
    network = Network.fresh(langs)
    network.fit(windows, labels, steps)
    return network


def _texts_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins (nulls are empty)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def predict_batch(network: Network | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Language and probability of each row of ``text, readable``."""
    readable = np.array(batch.column("readable").to_pylist(), bool)
    names, scores = [UNKNOWN] * len(readable), np.zeros(len(readable))
    if network is None or not readable.any():
        return names, scores
    data, offsets = _texts_as_bytes(batch.column("text"))
    rows = np.flatnonzero(readable)
    found = network.document_probabilities(data, offsets[rows], offsets[rows + 1])
    for row, probabilities in zip(rows, found, strict=True):
        best = int(probabilities.argmax())
        names[row], scores[row] = network.langs[best], min(1.0, float(probabilities[best]))
    return names, scores


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; ``und`` with score 0 where text is null or has no letter."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_batch(network, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    asked = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text", _has_letter().alias("readable"))
    return asked.mapInArrow(released(label), "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_readable(docs: DataFrame, network: Network | None, least: float = 0.0) -> DataFrame:
    """Rows whose language the network names, with at least that score. Where ``lang`` is null it becomes that language; all
    other columns are as they are.

    Without a network (nothing was labelled) no language can be told: every text with a letter stays.
    """
    names, schema = docs.columns, docs.schema
    flag = "__readable__"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column("text"), batch.column(flag)], names=["text", "readable"])
            found, scores = predict_batch(network, view)
            good = pa.array([name != UNKNOWN and score >= least for name, score in zip(found, scores, strict=True)], pa.bool_())
            if network is None:
                good = batch.column(flag)
            elif "lang" in names:
                named = pc.coalesce(batch.column("lang"), pa.array(found, pa.string()).cast(batch.column("lang").type))
                batch = batch.set_column(batch.schema.get_field_index("lang"), "lang", named)
            yield batch.select(names).filter(good)

    return docs.withColumn(flag, _has_letter()).mapInArrow(released(keep), schema)
