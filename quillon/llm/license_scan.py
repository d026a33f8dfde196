"""License scans: MinHash bands over overlapping windows of a text find templates, exact shingle containment confirms them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import textscan as T
from quillon.llm.confirm import parts
from quillon.llm.license_texts import TEMPLATES

#: Templates of fewer shingles are notices: they are found by their shingles themselves, since a window would hide them.
NOTICE = 13
#: MinHash values a band.
ROWS = 2
#: The smallest blocks that windows are made of, as a power of two.
_BASE = 2

# Words after which a notice says the opposite.
NEGATIONS = frozenset((b"not", b"no", b"never", b"nor", b"without", b"isn", b"aren", b"wasn", b"nicht", b"kein", b"keine", b"nie", b"pas", b"non", b"jamais"))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False


def scan_words(text: str) -> list[bytes]:
    """Words of a text as the scan sees them: A-Z lower-cased, runs of digits, letters and bytes beyond ASCII."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = T.words(raw, np.array([0, len(raw)]), _SEPARATOR)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def shingles(words: Sequence[bytes], width: int) -> set[bytes]:
    """The distinct runs of ``width`` words; fewer words have none."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def bands_needed(similarity: float, rows: int, certainty: float) -> int:
    """Bands of ``rows`` MinHash values of which, at this similarity, at least one agrees with this probability."""
    return math.ceil(math.log(1 - certainty) / math.log(1 - similarity**rows))


def window_of(size: int) -> tuple[int, int]:
    """(power, blocks): windows for a template of so many shingles are ``blocks`` blocks of 2 ** ``power`` shingles and begin
    at each block. The blocks but one hold the template, so it lies in some window whole; they are four or six,
    whichever fits closer, so a template has over two thirds of its blocks' shingles."""
    power = max(_BASE, math.ceil(math.log2(size / 4)))
    return (power - 1, 7) if power > _BASE and size <= 6 << (power - 1) else (power, 5)


def least_similarity(threshold: float) -> float:
    """The least Jaccard similarity of a window to a template of which it holds the threshold's share, over all sizes."""
    worst = 1.0
    for size in range(NOTICE, 4096):
        power, blocks = window_of(size)
        worst = min(worst, threshold * size / ((blocks << power) + (1 - threshold) * size))
    return worst


class _Index:
    """Notices by their shingles, and the other templates' band values by the windows they need. It travels with the tasks: its size is that of the templates, which the caller holds."""

    def __init__(self, templates: Sequence[tuple[str, str]], width: int, threshold: float, certainty: float):
        self.names, self.sets, hashes = [], [], []
        for name, text in templates:
            words = scan_words(text)
            if found := shingles(words, width):
                raw = np.frombuffer(b" ".join(words), np.uint8)
                starts, ends, _ = T.words(raw, np.array([0, len(raw)]), _SEPARATOR)
                self.names.append(name)
                self.sets.append(found)
                hashes.append(np.unique(T.window_hashes(T.word_hashes(raw, starts, ends), width, 4)))
        sizes = [len(h) for h in hashes]
        self.bands = bands_needed(least_similarity(threshold), ROWS, certainty)
        draw = np.random.default_rng(5)
        self.flips = draw.integers(0, 1 << 32, self.bands * ROWS, dtype=np.uint32)
        self.odds = draw.integers(0, 1 << 31, self.bands * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.notice = [n < NOTICE for n in sizes]
        pairs = sorted((int(h), i) for i, hs in enumerate(hashes) if self.notice[i] for h in hs)
        self.notice_hashes, self.notice_owner = np.array([h for h, _ in pairs], dtype=np.uint64), np.array([i for _, i in pairs], dtype=np.int64)
        self.kinds: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(sizes):
            if not self.notice[i]:
                self.kinds.setdefault(window_of(n), []).append(i)
        self.keys: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for kind, members in self.kinds.items():
            keys = []
            for band in range(self.bands):
                made = np.array([self.band(band, [self.mixed(band * ROWS + r, hashes[i]).min() for r in range(ROWS)]) for i in members], dtype=np.uint64)
                order = np.argsort(made)
                keys.append((made[order], np.array(members)[order]))
            self.keys[kind] = keys
        # Templates that share half of the smaller one's shingles are rivals for the same words.
        self.rivals = [[j for j, u in enumerate(self.sets) if j != i and 2 * len(t & u) >= min(len(t), len(u))] for i, t in enumerate(self.sets)]

    def mixed(self, function: int, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)).astype(np.uint32) ^ self.flips[function]) * self.odds[function]

    @staticmethod
    def band(number: int, minima: Sequence) -> np.ndarray:
        """One value of a band's two minima."""
        return (np.asarray(minima[0]).astype(np.uint64) << np.uint64(32)) | np.asarray(minima[1]).astype(np.uint64)


def _owners(keys: np.ndarray, owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place in ``values``, owner) wherever a value is among the sorted keys, which may repeat."""
    low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    for i in np.flatnonzero(high > low).tolist():
        for j in range(low[i], high[i]):
            yield i, int(owner[j])


def _scan(index: _Index, column: pa.Array, width: int, threshold: float) -> list[tuple[int, str, float, int, int]]:
    """(text, template, containment, first word, words) of the best window of each template found in each text."""
    raw, offsets = T.text_bytes(column)
    raw = _LOWER[raw]
    starts, ends, first = T.words(raw, offsets, _SEPARATOR)
    at, text = T.window_starts(first, width)
    if not len(at):
        return []
    hashes = T.window_hashes(T.word_hashes(raw, starts, ends), width, 4)[at]
    heads = np.searchsorted(text, np.arange(len(first)))  # each text's first shingle, and the end
    candidates: set[tuple[int, int, int]] = set()  # (first shingle, shingles, template)
    for i, t in _owners(index.notice_hashes, index.notice_owner, hashes):
        n = len(index.sets[t])
        candidates.add((max(int(heads[text[i]]), i - n + 1), 2 * n, t))
    # Blocks of each power: the first shingle and the text of each; two blocks make one of the next power.
    top = max((p for p, _ in index.kinds), default=_BASE)
    levels = []
    for power in range(_BASE, top + 1):
        per_text = -(-np.diff(heads) >> power)  # rounded up
        of_text = np.repeat(np.arange(len(per_text)), per_text)
        number = np.arange(len(of_text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        levels.append((heads[of_text] + (number << power), of_text))
    halves = []  # for each power but the first, where its blocks' halves are; a text's last block may have one only
    for (below, below_text), (begin, _) in zip(levels[:-1], levels[1:], strict=True):
        left = np.searchsorted(below, begin)
        right = np.minimum(left + 1, len(below) - 1)
        halves.append((left, np.where(below_text[right] == below_text[left], right, left)))
    if index.kinds:
        for band in range(index.bands):
            minima = [[], []]
            for r in range(ROWS):
                least = np.minimum.reduceat(index.mixed(band * ROWS + r, hashes), levels[0][0])
                minima[r].append(least)
                for left, right in halves:
                    minima[r].append(np.minimum(minima[r][-1][left], minima[r][-1][right]))
            for (power, blocks), known in index.keys.items():
                begin, of_text = levels[power - _BASE]
                window = []
                for r in range(ROWS):
                    out = minima[r][power - _BASE].copy()
                    for step in range(1, blocks):
                        if step < len(out):
                            same = of_text[step:] == of_text[:-step]
                            out[:-step] = np.where(same, np.minimum(out[:-step], minima[r][power - _BASE][step:]), out[:-step])
                    window.append(out)
                for i, t in _owners(*known[band], index.band(band, window)):
                    candidates.add((int(begin[i]), blocks << power, t))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    data = raw.tobytes()
    for low, size, t in sorted(candidates):
        row = int(text[low])
        high = min(low + size, int(heads[row + 1]))
        a, b = int(at[low]), int(at[high - 1]) + width
        words = [data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        share = len(index.sets[t] & shingles(words, width)) / len(index.sets[t])
        if share < threshold:
            continue
        if index.notice[t]:  # from its first shingle on, unless what stands before turns it round
            skip = next(k for k in range(len(words)) if b" ".join(words[k : k + width]) in index.sets[t])
            a += skip
            if any(data[starts[k] : ends[k]] in NEGATIONS for k in range(max(int(first[row]), a - 3), a)):
                continue
        if (share, -a) > (best.get((row, t), (0.0, 0, 0))[0], -best.get((row, t), (0.0, 0, 0))[1]):
            best[row, t] = (share, a, b - a)
    out = []
    for (row, t), (share, a, n) in sorted(best.items()):
        rank = lambda u, share: (round(share * len(index.sets[u])), share, len(index.sets[u]), -u)
        better = [u for u in index.rivals[t] if (row, u) in best and rank(u, best[row, u][0]) > rank(t, share)]
        if not any(best[row, u][1] < a + n and a < best[row, u][1] + best[row, u][2] for u in better):
            out.append((row, index.names[t], share, a - int(first[row]), n))
    return out


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, width: int = 5, threshold: float = 0.8, certainty: float = 0.9999) -> DataFrame:
    """``doc_id``, ``template``, ``containment``, ``word_start``, ``n_words``: the best window of each template in each text.

    A window holds a template if at least ``threshold`` of the template's distinct ``width``-word shingles occur in it.
    Windows overlap by all but a block, a fifth or seventh of them, and are little longer than the template
    (``window_of``), so one that occurs unbroken lies in a window whole. Bands of two MinHash values are so many
    that a window at the threshold agrees with the template in one with probability ``certainty``; what agrees is
    verified on the words. Notices, templates of fewer than NOTICE shingles, are looked up by their shingles instead;
    one right behind a negation ("not released under ...") is not reported. Equal shares go to the first window.

    Of rivals, templates that share half of the smaller one's shingles, whose windows overlap, only the best is
    reported: by the shingles found, then by share, size and order. So a text under one version of a license is not
    reported under another as well, nor a whole license under the header that it quotes.

    Null, empty and short texts hold nothing, nor do templates of fewer than ``width`` words match. Rows with equal or
    null ids are scanned each for itself; other columns are not read. Nothing is exchanged; a task holds one
    megabyte of texts, or one text, at a time.
    """
    index = _Index(templates, width, threshold, certainty)
    names = ["doc_id", "template", "containment", "word_start", "n_words"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = _scan(index, part.column("text"), width, threshold)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], names)

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, containment double, word_start long, n_words long")
