"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first 4 and 5 bytes (so that words of
one stem share what is learned). Filters over 1, 2 and 3 words, max pooling over the whole text, a linear layer.
The first embedding dimension starts from the smoothed log odds of a bucket in the training texts; the rest is random
and everything is trained by Adam. Max pooling lets gradients reach one window per filter and text only, so training
is cheap. Thresholds are calibrated on texts not trained on, by language; the language is guessed from function words
of the text alone, so that nothing but the text goes into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import GROUP_BYTES, column, groups, hashes, words

DIM, FILTERS, WIDTHS, PAD = 8, 8, (1, 2, 3), 3
WORDS, STEMS = 1 << 17, 1 << 15
#: Labelled rows that training takes at most: those with the smallest hash of doc_id.
MAX_ROWS = 8000
#: Longest text, in bytes, that the classifier is trained on; all are scored whole.
MAX_BYTES = 1 << 15
#: Frequent function words by language, for the guess of a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with are this on be".split(),
    "de": "der die und das den von zu mit ist im ein für auf sich des".split(),
    "fr": "le la les de des et en un une du est que dans pour par".split(),
    "es": "el los las del y en una por con para su se al es que".split(),
}
_LANGS = list(FUNCTION_WORDS)


def _buckets(h: np.ndarray, stem4: np.ndarray, stem5: np.ndarray) -> np.ndarray:
    """(n, 3) rows of the embedding table; row 0 is the padding."""
    out = np.empty((len(h), 3), np.int32)
    out[:, 0] = 1 + (h % np.uint64(WORDS)).astype(np.int32)
    out[:, 1] = 1 + WORDS + (stem4 % np.uint64(STEMS)).astype(np.int32)
    out[:, 2] = 1 + WORDS + STEMS + (stem5 % np.uint64(STEMS)).astype(np.int32)
    return out


_ROWS = 1 + WORDS + 2 * STEMS


def features(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words up to each row, buckets) of groups of texts."""
    offsets, data = column(arr)
    for i, j in groups(offsets, GROUP_BYTES // 2):
        first, s, e, low = words(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        yield i, j, first, _buckets(hashes(low, s, e), hashes(low, s, np.minimum(e, s + 4)), hashes(low, s, np.minimum(e, s + 5)))


@dataclass
class Model:
    table: np.ndarray  # (rows, DIM)
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.0})
    language: np.ndarray | None = None

    def pooled(self, first: np.ndarray, buckets: np.ndarray, winners: bool = False):
        """(texts, widths * FILTERS) maxima over the windows; with the positions that won, in padded words, if asked."""
        n = np.diff(first)
        docs = np.repeat(np.arange(len(n)), n)
        padded = np.zeros((len(buckets) + PAD * len(n), 3), np.int32)
        padded[np.arange(len(buckets)) + PAD * docs] = buckets
        vectors = self.table[padded[:, 0]]
        vectors += self.table[padded[:, 1]]
        vectors += self.table[padded[:, 2]]
        starts = first[:-1] + PAD * np.arange(len(n))
        ends = starts + n + 1  # windows from 0 to n, so that an empty text has one
        at = np.empty(2 * len(n), np.int64)
        at[0::2], at[1::2] = starts, ends
        tops, won = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            size = len(vectors) - w + 1
            c = vectors[:size] @ f[0]
            for k in range(1, w):
                c += vectors[k : k + size] @ f[k]
            c = np.concatenate([c, np.full((len(vectors) - size + 1, c.shape[1]), -1e9, np.float32)])
            top = np.maximum.reduceat(c, at, axis=0)[0::2]
            tops.append(top)
            if winners:
                held = np.repeat(top, n + PAD, axis=0) == c[: len(vectors)]
                pos, fil = np.nonzero(held)
                key = np.searchsorted(starts, pos, "right") - 1
                _, one = np.unique(key * FILTERS + fil, return_index=True)
                won.append(pos[one].reshape(len(n), FILTERS))
        return np.concatenate(tops, axis=1), padded, won

    def logits(self, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        top, _, _ = self.pooled(first, buckets)
        return np.maximum(top + self.bias, 0) @ self.out + self.out_bias

    def languages(self, first: np.ndarray, buckets: np.ndarray) -> list[str]:
        counts = np.concatenate([np.zeros((1, len(_LANGS)), np.int64), np.cumsum(self.language[buckets[:, 0]], axis=0, dtype=np.int64)])
        each = counts[first[1:]] - counts[first[:-1]]
        best = each.argmax(axis=1)
        return [_LANGS[b] if each[i, b] else "" for i, b in enumerate(best)]

    def scores(self, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        theta = np.array([self.thresholds.get(k, self.thresholds[""]) for k in self.languages(first, buckets)])
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.logits(first, buckets) - theta), -40, 40)))


def _language_table() -> np.ndarray:
    out = np.zeros((_ROWS, len(_LANGS)), np.uint8)
    for i, lang in enumerate(_LANGS):
        raw = [w.encode() for w in FUNCTION_WORDS[lang]]
        ends = np.cumsum([len(w) for w in raw])
        h = hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends)
        out[1 + (h % np.uint64(WORDS)).astype(np.int64), i] = 1
    return out


def _log_odds(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.zeros((2, _ROWS), np.float64)
    for t, label in zip(texts, y, strict=True):
        counts[int(label), np.unique(t)] += 1
    n = np.maximum(np.bincount(y.astype(int), minlength=2), 1)[:, None]
    rate = (counts + 0.5) / (n + 1)
    seen = counts.sum(axis=0)
    out = np.log(rate[1] / rate[0]) * seen / (seen + 3)
    out[0] = 0
    return out.astype(np.float32)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v, n = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        n += 1
        self.state[name][2] = n
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**n)) / (np.sqrt(v[at] / (1 - 0.99**n)) + 1e-6)


def _packed(texts: list[np.ndarray], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = [texts[i] for i in pick]
    first = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
    return first, np.concatenate(some) if some else np.zeros((0, 3), np.int32)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 3) -> Model:
    """texts: (words, 3) buckets each; y: 0 or 1. A fifth of them, evenly spaced, is held out for the thresholds."""
    rng = np.random.default_rng(seed)
    y = y.astype(np.float32)
    model = Model(rng.normal(0, 0.05, (_ROWS, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, language=_language_table())
    model.table[0] = 0
    if not len(y) or y.min() == y.max():  # nothing to learn: every text gets the rate of the label
        model.out[:] = 0
        model.out_bias = 4.0 if len(y) and y.max() else -4.0
        return model
    order = rng.permutation(len(y))
    held, fit = order[::5], np.setdiff1d(order, order[::5])
    model.table[:, 0] = _log_odds([texts[i] for i in fit], y[fit]) / 3
    for w, f in zip(WIDTHS, model.filters, strict=True):
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) / w + 0.5 / w
    model.out[:] = np.abs(model.out) * np.tile(np.r_[np.ones(FILTERS // 2), -np.ones(FILTERS - FILTERS // 2)], len(WIDTHS))
    model.out_bias = float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    opt, bias = _Adam(0.01), np.array([model.out_bias], np.float32)
    weight = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())).astype(np.float32)
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            pick = fit[k : k + batch]
            first, buckets = _packed(texts, pick)
            top, padded, won = model.pooled(first, buckets, winners=True)
            act = np.maximum(top + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + bias[0], -30, 30)))
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_act = (g[:, None] * model.out) * (top + model.bias > 0)
            rows, grads = [], []
            for i, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                d = d_act[:, i * FILTERS : (i + 1) * FILTERS]
                df = np.zeros_like(f)
                for o in range(w):
                    at = padded[np.minimum(won[i] + o, len(padded) - 1)]  # (texts, FILTERS, 3)
                    vec = model.table[at].sum(axis=2)  # (texts, FILTERS, DIM)
                    df[o] = np.einsum("nf,nfd->df", d, vec)
                    grads.append(np.repeat((d[:, :, None] * f[o].T[None])[:, :, None, :], 3, axis=2).reshape(-1, DIM))
                    rows.append(at.reshape(-1))
                opt.step(f"f{w}", f, df)
            rows, where = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, where, np.concatenate(grads))
            total, rows = total[rows > 0], rows[rows > 0]
            opt.step("out", model.out, act.T @ g + 1e-4 * model.out)
            opt.step("bias", model.bias, d_act.sum(axis=0))
            opt.step("out_bias", bias, g.sum(keepdims=True))
            opt.step("table", model.table, total, rows)
    model.out_bias = float(bias[0])
    _calibrate(model, texts, y, held)
    return model


def _threshold(z: np.ndarray, y: np.ndarray, clean_weight: float = 2.0) -> float:
    """The middle of the best gap: fewest errors, a clean text rejected counting clean_weight times."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)])
    wrong = np.concatenate([[0], np.cumsum(1 - y)])
    cost = missed + clean_weight * (wrong[-1] - wrong)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gap = np.concatenate([[0], np.diff(z), [0]])
    best = np.flatnonzero(cost == cost.min())
    return float(edges[best[np.argmax(gap[best])]])


def _calibrate(model: Model, texts: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> None:
    z, langs = [], []
    for k in range(0, len(held), 256):
        first, buckets = _packed(texts, held[k : k + 256])
        z.append(model.logits(first, buckets))
        langs += model.languages(first, buckets)
    z, y, langs = np.concatenate(z), y[held], np.array(langs)
    if y.min() == y.max():
        return
    overall = model.thresholds[""] = _threshold(z, y)
    for lang in _LANGS:
        own = langs == lang
        if min(y[own].sum(), (1 - y[own]).sum()) >= 15:
            model.thresholds[lang] = _threshold(z[own], y[own])
        elif own.any():
            model.thresholds[lang] = overall


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, first, buckets in features(batch.column("text")):
            rows = [buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array(rows, pa.binary())], ["doc_id", "label", "words"])


def fit(docs: DataFrame, labels: DataFrame, usable=None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on the labelled rows of docs; labels: (doc_id, toxic). usable: a condition on doc_id, if not all may be used.

    Takes max_rows labels at most, and of their texts those of max_bytes at most, so what the driver holds is bounded;
    of several texts of one doc_id the smallest. Null labels are left out; if a doc_id has
    several, the largest counts. Without labels of both kinds the model gives all texts one score.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = known.select("doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")  # max_rows rows of two numbers
    got = rows.mapInArrow(_featured, "doc_id long, label int, words binary").toArrow()
    got = got.sort_by("doc_id")
    texts = [np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 3) for w in got.column("words")]
    return train(texts, np.array(got.column("label").to_pylist(), np.float32))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with score and predicted (score >= 0.5), from the text alone; null counts as empty.

    Rows that repeat a doc_id are scored one by one; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.scores(first, buckets) for _, _, first, buckets in features(batch.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.scores(first, buckets) for _, _, first, buckets in features(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(parts) < 0.5 if parts else np.zeros(0, bool)))

    return docs.mapInArrow(keep, docs.schema)
