"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features count kinds of characters and repeated words, in the line
and its neighbours; line states follow each other with learned weights. Forward-backward sums give
each line's probability of being good; their mean, weighted by line lengths, is the document's
quality, calibrated by a logistic curve.

Labels are known for documents only. Training starts from lines that carry their document's label
and then alternates: lines of bad documents get the state the model gives them (the worst line of
each stays bad), the model is fitted again. It sees a bounded sample of labelled documents, each whole. How many steps
a fit takes is chosen by the loss on a fifth of these training documents, left out for that; labels of the
held-out documents play no part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.bpe import text_or_empty
from presswork.llm.common import map_texts

#: Labelled documents for the fit (least hashes of id; whole texts), rounds, step size and decay.
SAMPLE, ROUNDS, STEP, DECAY = 3_000, 3, 0.1, 1e-3
#: Steps of a round to choose from, and the part of the training documents that the choice is made on.
STEPS, INNER = (8, 15, 25, 40), 5
THRESHOLD = 0.3

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*+=~^<>{}[]\\_/@", " \t\r\x0b\x0c"]
_TABLE = np.full(256, len(_CLASSES), np.int64)
for _k, _chars in enumerate(_CLASSES):
    _TABLE[np.frombuffer(_chars.encode(), np.uint8)] = _k
_WEIGHT = np.random.default_rng(5).integers(1, 2**62, 256, dtype=np.uint64)
N_OWN = len(_CLASSES) + 6
N = 1 + 3 * N_OWN


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """The features of a text's lines: a constant, their own ones, those of the line before and of the line after."""
    zero = np.zeros((1, own.shape[1]))
    return np.column_stack([np.ones(len(own)), own, np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero])])


def line_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of one text given as bytes; an empty text has one empty line."""
    own, lengths = own_features(raw)
    return with_neighbours(own), lengths


def own_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features without neighbours, lengths) of the lines of one text."""
    ends = np.concatenate([np.flatnonzero(raw == 10), [len(raw)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, lengths = len(ends), ends - starts
    line = np.repeat(np.arange(n), np.diff(ends, prepend=-1))[: len(raw)]
    kind = _TABLE[raw]
    counts = np.bincount(line * (len(_CLASSES) + 1) + kind, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1).astype(float)
    counts[:, -1] -= np.bincount(line[raw == 10], minlength=n)  # line ends belong to no line
    # words: runs between white space; a word's signature is the sum of its letters' weights
    solid = (kind != len(_CLASSES) - 1) & (raw != 10)
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    words = np.zeros(n)
    repeats = np.zeros(n)
    if len(first):
        sums = np.add.reduceat(np.where(solid, _WEIGHT[raw], np.uint64(0)), first)
        at = line[first]
        words = np.bincount(at, minlength=n).astype(float)
        again = (sums[1:] == sums[:-1]) & (at[1:] == at[:-1])
        repeats = np.bincount(at[1:][again], minlength=n).astype(float)
    size = np.maximum(lengths, 1)[:, None]
    per_word = np.maximum(words, 1)
    own = np.column_stack([
        np.sqrt(counts[:, :-1] / size),
        counts[:, -1] / size[:, 0],
        np.log1p(lengths) / 5,
        size[:, 0] / per_word / 10,
        np.sqrt(repeats / per_word),
        np.minimum(1, counts[:, 4] / per_word),
        np.minimum(1, (counts[:, 5] + counts[:, 6]) / per_word),
    ])
    return own, lengths


class Chain:
    """Weights of the field, and the curve that turns mean line quality into a score."""

    def __init__(self) -> None:
        self.emit, self.step = np.zeros(N), np.zeros((2, 2))
        self.curve = (0.0, 0.0)

    def marginals(self, x: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and expected numbers of state pairs. Documents lie end to end
        (``first`` line, ``count`` of lines) and take their steps together."""
        score = x @ self.emit
        emit = np.column_stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))])  # bad, good; at most 1
        move = np.exp(self.step - self.step.max())
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        fore, back = emit.copy(), np.ones_like(emit)
        fore[first] /= fore[first].sum(1, keepdims=True)
        longest = int(count[0]) if len(count) else 0
        live = np.searchsorted(-count, -np.arange(1, longest + 1), side="right")  # documents with a line t
        for t in range(1, longest):
            at = first[: live[t]] + t
            a = fore[at - 1] @ move * emit[at]
            fore[at] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[: live[t + 1]] + t
            b = (back[at + 1] * emit[at + 1]) @ move.T
            back[at] = b / b.sum(1, keepdims=True)
        p = fore * back
        p /= p.sum(1, keepdims=True)
        inner = np.ones(len(x), bool)
        inner[first + count - 1] = False
        at = np.flatnonzero(inner)
        joint = fore[at][:, :, None] * move[None] * (emit[at + 1] * back[at + 1])[:, None, :]
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
        return p[:, 1], joint.sum(0)

    def fit_chain(self, x: np.ndarray, first: np.ndarray, count: np.ndarray, state: np.ndarray, weight: np.ndarray, steps: int) -> None:
        """Gradient steps (Adam) on the likelihood of the lines' states."""
        inner = np.ones(len(x), bool)
        inner[first + count - 1] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[at].astype(int), state[at + 1].astype(int)), 1)
        m = [np.zeros(N), np.zeros((2, 2))]
        v = [np.zeros(N), np.zeros((2, 2))]
        total = weight.sum()
        for k in range(1, steps + 1):
            p, joint = self.marginals(x, first, count)
            grads = [x.T @ (weight * (state - p)) / total - DECAY * self.emit, (seen - joint) / len(x) - DECAY * self.step]
            for i, (g, w) in enumerate(zip(grads, (self.emit, self.step), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w += STEP * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-6)

    def mean_quality(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        p, _ = self.marginals(x, first, count)
        weight = length + 1.0  # an empty line counts as its line end
        owner = np.repeat(np.arange(len(first)), count)
        return np.bincount(owner, p * weight, len(first)) / np.bincount(owner, weight, len(first))

    def scores(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * quality, -30, 30)))


def chosen_steps(parts: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray) -> int:
    """The number of steps whose chain, fitted without each ``INNER``-th document, has the least loss on these."""
    inner = np.arange(len(parts)) % INNER == 0
    take = lambda rows, of: [r for r, on in zip(rows, of, strict=True) if on]
    if len(parts) < 2 * INNER:
        return STEPS[0]
    x, length = take(parts, inner), take(lengths, inner)
    count = np.array([len(p) for p in x])

    def loss(steps: int) -> float:
        model = fit(take(parts, ~inner), take(lengths, ~inner), labels[~inner], steps)
        p = model.scores(model.mean_quality(np.concatenate(x), np.concatenate(length), np.cumsum(count) - count, count))
        return float(-np.log(np.where(labels[inner] == 1, p, 1 - p)).mean())

    return min(STEPS, key=loss)


def fit(parts: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, steps: int) -> Chain:
    """The chain of documents given by their lines' features, lengths and labels (0 or 1)."""
    model = Chain()
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.curve = (float(np.log(share / (1 - share))), 0.0)
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart: the share of label 1
        return model
    x, length = np.concatenate(parts), np.concatenate(lengths)
    count = np.array([len(p) for p in parts])
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(parts)), count)
    state = labels[owner].astype(float)
    for _ in range(ROUNDS):
        mass = np.array([(state == s).sum() for s in (0, 1)], float)
        weight = (len(state) / 2 / np.maximum(mass, 1))[state.astype(int)]
        model.fit_chain(x, first, count, state, weight, steps)
        p, _ = model.marginals(x, first, count)
        state = np.where(labels[owner] == 1, 1.0, (p > 0.5).astype(float))
        for d in np.flatnonzero(labels == 0):
            own = slice(first[d], first[d] + count[d])
            state[own][np.argmin(p[own])] = 0.0
    q = model.mean_quality(x, length, first, count)
    a, b = model.curve[0], 0.0
    for _ in range(60):  # Newton steps with a little decay
        p = 1 / (1 + np.exp(-np.clip(a + b * q, -30, 30)))
        w = p * (1 - p)
        g = np.array([(labels - p).sum(), ((labels - p) * q).sum() - 0.05 * b])
        h = np.array([[w.sum(), (w * q).sum()], [(w * q).sum(), (w * q * q).sum()]]) + np.diag([1e-6, 0.05])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
    model.curve = (float(a), float(b))
    return model


def held_out(key: Column) -> Column:
    """Whether a document's label is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, text) to (doc_id, quality, x, lengths): the lines' own features as 32-bit floats and their
    lengths, both as bytes."""
    for batch in batches:
        made = [own_features(np.frombuffer(text.encode("utf-8", "replace"), np.uint8)) for text in text_or_empty(batch)]
        xs = [own.astype("<f4").tobytes() for own, _ in made]
        ls = [length.astype("<i8").tobytes() for _, length in made]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary()), pa.array(ls, pa.binary())], ["doc_id", "quality", "x", "lengths"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain of at most ``sample`` labelled documents outside the held-out fifth.

    Labels other than 0 and 1, null ids and labels without a document are passed over; of labels with one id
    the smaller counts, of documents with one id the one with the least features. Null text is empty. Without labels,
    or with labels of one kind, each text scores the share of good ones, 0.5 for none. The driver holds at most
    ``sample`` documents, as 56 bytes of features for each line."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers: small enough to be sent to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("text").cast("string").alias("text"))
    made = map_texts(texts, _features, "doc_id long, quality int, x binary, lengths binary", "quality")
    one = made.groupBy("doc_id").agg(F.min(F.struct("quality", "x", "lengths")).alias("r")).select("doc_id", "r.*")
    rows = sorted(one.collect(), key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    parts = [with_neighbours(np.frombuffer(r.x, "<f4").reshape(-1, N_OWN).astype(float)) for r in rows]
    lengths = [np.frombuffer(r.lengths, "<i8") for r in rows]
    known_as = np.array([r.quality for r in rows], np.int64)
    return fit(parts, lengths, known_as, chosen_steps(parts, lengths, known_as))


def score(docs: DataFrame, model: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of all rows.

    Only the text is an input. Null text is empty; an empty text is one empty line and has a score
    like any other; null ids are not held out; repeated rows score alike; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_or_empty(batch)
            out, at = np.zeros(len(texts)), 0
            while at < len(texts):  # some megabytes of text at a time
                xs, ls, begin, held = [], [], at, 0
                while at < len(texts) and held < 2_000_000:
                    raw = np.frombuffer(texts[at].encode("utf-8", "replace"), np.uint8)
                    x, length = line_features(raw)
                    xs.append(x)
                    ls.append(length)
                    held += len(raw) + len(length) * 8
                    at += 1
                count = np.array([len(x) for x in xs])
                q = model.mean_quality(np.concatenate(xs), np.concatenate(ls), np.cumsum(count) - count, count)
                out[begin:at] = model.scores(q)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = map_texts(some, run, "doc_id long, score double", "quality")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Chain) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns as they are.

    Null text is empty and judged like any other; repeated rows and ids are judged row by row; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = text_or_empty(part)
                made = [line_features(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t in texts]
                count = np.array([len(x) for x, _ in made])
                q = model.mean_quality(np.concatenate([x for x, _ in made]), np.concatenate([n for _, n in made]), np.cumsum(count) - count, count)
                yield part.filter(pa.array(model.scores(q) >= THRESHOLD))

    return map_texts(docs, run, docs.schema, "quality").select(names)
