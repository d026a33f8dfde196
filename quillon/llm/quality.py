"""A quality score from random-indexing word vectors and a small neural network with calibrated probabilities.

Each word has a sparse random index vector. A word's vector is its own index vector plus those of its neighbours
in the learning sample, at unit length; words other than the most frequent ones share vectors by a hash. A text is the
mean of its words' vectors, beside the mean of the index vectors of its words' shapes, so that words that the sample
lacks still say how they look.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import others, plainly_named
from quillon.llm.components import ensure_checkpoint_dir

#: Labelled texts learned from at most; words that have a vector to themselves, and vectors that all other words share.
SAMPLE, VOCABULARY, SHARED = 6_000, 20_000, 4_096
DIM, HIDDEN, SPARSE = 64, 32, 6


def index_vector(word: bytes, dim: int = DIM) -> np.ndarray:
    """A few entries of +1 and -1, by a hash of the word."""
    draw = np.random.default_rng(zlib.crc32(word))
    out = np.zeros(dim, dtype=np.float32)
    out[draw.choice(dim, SPARSE, replace=False)] = draw.integers(0, 2, SPARSE) * 2 - 1
    return out


# What a byte looks like: upper and lower case, digits, anything beyond ASCII as lower case, all others themselves.
_LOOKS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """How a whole word looks: its runs of upper and lower case, digits, other ASCII and bytes beyond."""
    return b"\x00" + _AGAIN.sub(rb"\1", word.translate(_LOOKS))


def row_of(words: dict[bytes, int], word: bytes) -> int:
    """The row of a word's vector: its own, or one of SHARED rows after these, which the rarer words share by a hash."""
    found = words.get(word)
    return found if found is not None else len(words) + zlib.crc32(word) % SHARED


def own_vectors(words: dict[bytes, int]) -> np.ndarray:
    """The index vectors of all rows."""
    return np.array([index_vector(w) for w in (*words, *(b"\x01%d" % i for i in range(SHARED)))], dtype=np.float32)


@dataclass(frozen=True)
class Model:
    """Word vectors of the sample and a network; at most VOCABULARY words and SHARED further vectors, so of bounded size."""

    words: dict[bytes, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, features: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = np.tanh(((features - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / (temperature or self.temperature), -40, 40)))


class _Pooler:
    """Means of word and shape vectors; which rows a word takes is kept until there are too many words."""

    def __init__(self, words: dict[bytes, int], vectors: np.ndarray, most: int = 200_000):
        self.words, self.vectors, self.most = words, vectors, most
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}  # row of the vector, then 32 bits for the row of the shape
        self.shapes: dict[bytes, int] = {}
        self.looks = np.zeros((0, DIM), dtype=np.float32)

    def pool(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(2 * DIM + 1, dtype=np.float32)
        if len(self.codes) > self.most or len(self.shapes) > 1 << 14:
            self._clear()
        found = list(map(self.codes.get, words))
        if None in found:
            for w in words:
                if w not in self.codes:
                    look = self.shapes.setdefault(shape(w), len(self.shapes))
                    self.codes[w] = row_of(self.words, w) << 32 | look
            if len(self.shapes) > len(self.looks):
                new = list(self.shapes)[len(self.looks) :]
                self.looks = np.concatenate([self.looks, np.array([index_vector(x) for x in new])])
            found = list(map(self.codes.__getitem__, words))
        codes = np.array(found)
        total = np.zeros(DIM, dtype=np.float64)
        for at in range(0, len(codes), 1 << 14):  # bounds the memory that a very long text takes
            total += self.vectors[codes[at : at + (1 << 14)] >> 32].sum(axis=0, dtype=np.float32)
        looks = np.bincount(codes & 0xFFFFFFFF, minlength=len(self.looks)) @ self.looks
        # The share of words said before within the text, beside the pooled vectors.
        return np.concatenate([total / len(codes), looks / len(codes), [1 - len(set(words)) / len(codes)]]).astype(np.float32)


def _fit(words: dict[bytes, int], vectors: np.ndarray, x: np.ndarray, labels: np.ndarray, seed: int = 8) -> Model:
    """A network by gradient descent on four fifths of the rows, its temperature on the rest; both labels weigh the same."""
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1e-9, y[train].mean()), 0.5 / max(1e-9, 1 - y[train].mean()))
    step = 0
    for _ in range(40):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            step += 1
            h0 = (x[part] - mean) / scale
            h1 = np.tanh(h0 @ params[0] + params[1])
            z = np.clip(h1 @ params[2] + params[3][0], -40, 40)
            g = (1 / (1 + np.exp(-z)) - y[part]) * weight[part] / len(part)
            gh = np.outer(g, params[2]) * (1 - h1**2)
            grads = [h0.T @ gh + 1e-4 * params[0], gh.sum(axis=0), h1.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                params[i] = params[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(words, vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if len(hold) and 0 < y[hold].mean() < 1:  # the temperature with the least log loss on rows that were held back
        loss = lambda t: -np.mean(weight[hold] * np.log(np.clip(np.where(y[hold] == 1, p := model.probability(x[hold], t), 1 - p), 1e-9, 1)))
        best = min(np.geomspace(0.25, 8, 31), key=loss)
        model = Model(words, vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), float(best))
    return model


def learn_quality(docs: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, least: int = 2) -> Model | None:
    """A model from ``doc_id``, ``text`` and ``label`` (0 or 1) of at most about ``sample`` rows, chosen by a hash of the id.

    Words that occur at least ``least`` times in the sample, the ``vocabulary`` most frequent ones, have a vector each; all
    others share SHARED vectors by a hash, in learning and in scoring alike. Both bound the model, not what is scored.

    Null labels are passed over; null texts are empty; rows that repeat or share an id are learned from each; other
    columns are not read. Without rows of both labels there is no model.
    """
    docs = docs.where(F.col("label").isNotNull())
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    ensure_checkpoint_dir(docs.sparkSession)
    chosen = chosen.select("doc_id", F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text")).checkpoint()
    words = chosen.select(F.explode(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    counted = words.groupBy("w").count().where(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(vocabulary).select("w").collect()
    index = {r.w.encode(): i for i, r in enumerate(counted)}
    own = own_vectors(index)
    shared = docs.sparkSession.sparkContext.broadcast((index, own))  # bounded by ``vocabulary``

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = shared.value
        total = np.zeros(own.shape, dtype=np.float32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n = np.fromiter((row_of(index, w) for w in text.encode().split()), np.int64)
                np.add.at(total, n[:-1], own[n[1:]])
                np.add.at(total, n[1:], own[n[:-1]])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_pydict({"n": some, "v": list(total[some].astype(np.float64))}, pa.schema([("n", pa.int64()), ("v", pa.list_(pa.float64()))]))

    sums = chosen.select("text").mapInArrow(neighbours, "n long, v array<double>").groupBy("n").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v")).collect()
    total = own * 2
    for r in sums:
        total[r.n] += np.array(r.v, dtype=np.float32)
    unit = total / np.maximum(1e-6, np.linalg.norm(total, axis=1, keepdims=True))
    learned = docs.sparkSession.sparkContext.broadcast((index, unit))  # bounded by ``vocabulary``

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = _Pooler(*learned.value)
        for batch in batches:
            x = [pooler.pool(t.encode().split()).astype(np.float64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": x}, pa.schema([("doc_id", batch.schema.field("doc_id").type), ("label", pa.int32()), ("x", pa.list_(pa.float64()))]))

    rows = chosen.mapInArrow(pool, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, label int, x array<double>").collect()  # bounded by the sample
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.label, r.x))
    labels = np.array([r.label for r in rows])
    if len(set(labels.tolist())) < 2:
        return None
    return _fit(index, unit, np.array([r.x for r in rows]), labels)


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) added; columns of these names are replaced.

    Only ``text`` decides, read whole; null, empty and blank texts score as a text without words does. Equal texts
    score alike. Without a model every score is 0.5. An empty table gives an empty table.
    """
    keep = docs.select(*others(docs, ("score", "predicted")))
    plain = plainly_named(keep, "text")
    schema = plain.withColumn("score", F.lit(0.0)).schema
    # Plain values: a class would have to be imported by the workers, which need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple(getattr(model, f.name) for f in fields(model)))  # bounded by the fit's vocabulary

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        pooler = _Pooler(model.words, model.vectors) if model else None
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model:
                features = np.array([pooler.pool((t or "").encode().split()) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, 2 * DIM + 1)
                scores = np.round(model.probability(features.astype(np.float64)), 9)  # the same for equal texts wherever they stand in a batch
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return plain.mapInArrow(f, schema).toDF(*keep.columns, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Is crc32 of the id, as text, 1 modulo 3."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1
