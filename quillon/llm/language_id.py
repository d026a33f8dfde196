"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, each rotated
by its place; a text is the sum of its trigrams and a language the sum of its texts' unit vectors. Texts are compared
with languages by cosine. Words are padded with a boundary mark, which has a vector of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import others, plainly_named

#: Texts that prototypes are learned from at most, chosen by a hash of their id; enough for some dozens of languages.
SAMPLE = 20_000
#: Trigrams whose vectors a task holds at a time.
_SLAB = 1 << 12
#: Letters whose vectors a task keeps; those of others are made anew from the letter when they are needed.
_LETTERS = 2048


@dataclass(frozen=True)
class Profiles:
    """Unit vectors of languages; its size is the number of languages times the dimension."""

    languages: tuple[str, ...]
    vectors: np.ndarray


class _Encoder:
    """Turns batches of texts into trigram counts and vectors; a letter's number is its code point, 0 is a boundary."""

    def __init__(self, dim: int):
        self.dim = dim
        self.number = np.full(0x110000, -1, dtype=np.int32)  # -1: not met
        self.known: dict[int, np.ndarray] = {}

    def _vector(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= _LETTERS:
                self.known.clear()
            self.known[code] = np.random.default_rng([code, 9]).integers(0, 2, self.dim).astype(np.float32) * 2 - 1
        return self.known[code]

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        out = self.number[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                self.number[code] = code if chr(code).isalpha() else 0
            out = self.number[codes]
        return out

    def trigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index and trigram code of all trigrams with a letter in the middle, and whether each text has a letter."""
        parts, sizes = [], []
        for t in texts:
            part = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            parts.append(part)
            sizes.append(len(part) + 2)
        text = np.repeat(np.arange(len(texts)), sizes)
        n = np.zeros(len(text), dtype=np.int64)  # a boundary before and after each text
        at = np.cumsum([0, *sizes[:-1]]) + 1
        inner = np.ones(len(text), dtype=bool)
        inner[at - 1] = False
        inner[np.cumsum(sizes) - 1] = False
        if parts:
            n[inner] = self._numbers(np.concatenate(parts))
        middle = np.flatnonzero(n)
        codes = (n[middle - 1] << 42) | (n[middle] << 21) | n[middle + 1]
        return text[middle], codes, np.bincount(text[middle], minlength=len(texts)) > 0

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams; only those of their own letters are held together."""
        letters, at = np.unique(np.concatenate([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]), return_inverse=True)
        table = np.array([self._vector(x) for x in letters.tolist()], dtype=np.float32).reshape(-1, self.dim)
        a, b, c = at.reshape(3, -1)
        return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def _blocks(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, at most 256 texts; one text is never cut."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 - at >= 256:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encode(encoder: _Encoder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of each text (zero without letters), and whether it has a letter."""
    text, codes, has = encoder.trigrams(texts)
    distinct, column = np.unique(codes, return_inverse=True)
    out = np.zeros((len(texts), encoder.dim), dtype=np.float32)
    for at in range(0, len(distinct), _SLAB):  # bounds memory where a block has very many distinct trigrams
        here = (column >= at) & (column < at + _SLAB)
        width = min(_SLAB, len(distinct) - at)
        counts = np.bincount(text[here] * width + (column[here] - at), minlength=len(texts) * width).reshape(len(texts), width)
        out += counts.astype(np.float32) @ encoder.vectors(distinct[at : at + width])
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return out / np.maximum(norm, 1e-12)[:, None].astype(np.float32), has


def learn_profiles(docs: DataFrame, sample: int = SAMPLE, dim: int = 1024) -> Profiles:
    """Language prototypes from ``doc_id``, ``text`` and non-null ``lang``, from at most about ``sample`` texts.

    The sample is those texts whose hashed id falls below a share; partial sums meet by language and dimension.
    Texts without letters add nothing. Without any labelled text there are no languages.
    """
    docs = docs.where(F.col("lang").isNotNull())
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("text", F.col("lang").cast("string").alias("lang"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = _Encoder(dim), {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i, j in _blocks(texts):
                vectors, _ = _encode(encoder, texts[i:j])
                for lang in set(langs[i:j]):
                    mine = np.array([x == lang for x in langs[i:j]])
                    sums[lang] = sums.get(lang, 0) + vectors[mine].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "at": np.arange(dim), "value": np.round(total * 2**20).astype(np.int64)})

    rows = chosen.mapInArrow(f, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()  # languages times dim
    languages = tuple(sorted({r.lang for r in rows}))
    vectors = np.zeros((len(languages), dim))
    for r in rows:
        vectors[languages.index(r.lang), r.at] = r.value
    return Profiles(languages, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of these names are replaced); only ``text`` decides.

    ``score`` is the cosine with the nearest language, cut to 0 to 1. ``und`` with score 0 where text is null or has
    no letter, or no language was learned. Equal cosines go to the language that sorts first. Texts of any length
    are read whole. An empty table gives an empty table.
    """
    keep = docs.select(*others(docs, ("lang_pred", "score")))
    plain = plainly_named(keep, "text")
    schema = plain.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    languages, prototypes = profiles.languages, profiles.vectors
    dim = prototypes.shape[1] if len(languages) else 64

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(dim)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [], []
            for i, j in _blocks(texts):
                vectors, has = _encode(encoder, texts[i:j])
                if not len(languages):
                    has[:] = False
                cosine = vectors @ prototypes.T if len(languages) else np.zeros((j - i, 1))
                best = cosine.argmax(axis=1)
                names += [languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores += [float(min(1.0, max(0.0, c[b]))) if h else 0.0 for c, b, h in zip(cosine, best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(f, schema).toDF(*keep.columns, "lang_pred", "score")


def held_out(remainder: int, modulus: int, key: str = "doc_id") -> Column:
    """Is crc32 of the id, as text, that remainder of the modulus."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder
