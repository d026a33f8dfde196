"""Token ids of texts by way of their pieces: a tokenizer encodes each distinct piece once per worker process.

Byte-pair tokenizers cut a text into pieces by a pattern and encode each piece alone, so the ids of a text are the ids
of its pieces in order. That holds here for texts of Latin characters without the tokenizer's special strings;
any other text is encoded whole by the tokenizer itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from itertools import islice, repeat

import numpy as np

# The piece patterns of the public vocabularies, over the Latin characters up to U+017F.
_LETTERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c)).startswith("L"))
_NUMBERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c)).startswith("N"))
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "byte": re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"),
}
#: Characters on which Python and the tokenizers might differ: separators 0x1C-0x1F, the dotted capital I, and all beyond Latin but common punctuation.
_OTHER = re.compile("[^\x00-\x1b\x20-įı-ſ‐-‧€]")


class PieceEncoder:
    """Ids of texts for a .json vocabulary of kind "byte" (all bytes kept) or "word" (lower case, white space dropped)."""

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "byte" if self.tokenizer.normalizer is None else "word"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._clear()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """The encoder of this worker process; later tasks find its table filled."""
        # Functions are sent to workers by value, so a table of this module would be a new one for each task; one of a
        # module that every worker imports by itself stays.
        held = sys.__dict__.setdefault("_piece_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(s in text for s in self.special)

    def split(self, text: str) -> list[str]:
        """The pieces of a plain text."""
        return _PATTERNS[self.kind].findall(text.lower() if self.kind == "word" else text)

    def _learn(self, pieces: list[str]) -> None:
        # Pieces that keep apart when they are joined are encoded in one go, the others alone.
        if self.kind == "word":
            joined, rest = [p for p in pieces if p[0] in _LETTERS], [p for p in pieces if p[0] not in _LETTERS]
            text = " ".join(joined)
        else:
            joined, rest = [p for p in pieces if p[0] == " " and p[1:2] and p[1] in _LETTERS], [p for p in pieces if not (p[0] == " " and p[1:2] and p[1] in _LETTERS)]
            text = "".join(joined)
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        if joined:
            encoding = self.tokenizer.encode(text, add_special_tokens=False)  # which words ids belong to is not told by the fast form
            ids.append(np.array(encoding.ids, dtype=np.uint32))
            sizes += np.bincount(np.array(encoding.word_ids, dtype=np.int64), minlength=len(joined)).tolist()
            if len(sizes) != len(joined):
                raise AssertionError("joined pieces did not keep apart")
        for encoding in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(encoding.ids, dtype=np.uint32))
            sizes.append(len(encoding.ids))
        n, new = len(self.index), np.concatenate(ids)
        for name, need in (("ids", self.used + len(new)), ("first", n + len(sizes)), ("size", n + len(sizes))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(need + len(old), dtype=old.dtype)]))
        self.ids[self.used : self.used + len(new)] = new
        self.size[n : n + len(sizes)] = sizes
        self.first[n : n + len(sizes)] = self.used + np.cumsum([0, *sizes[:-1]])
        self.used += len(new)
        self.index.update(zip(joined + rest, range(n, n + len(sizes)), strict=True))

    def _shrink(self) -> None:
        """Keeps the half that was learned first: what is met early is what is met often."""
        keep = self.most // 2
        self.used = int(self.first[keep])
        self.index = dict(islice(self.index.items(), keep))

    def lookup(self, pieces: list[str]) -> np.ndarray:
        """The table's row of each piece; before that a table that has grown too large is cut to half its bound."""
        if len(self.index) > self.most:
            self._shrink()
        rows = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            names = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(names)))
            rows[missing] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        return rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them without added special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        pieces, where, counts = [], [], []
        for i, t in enumerate(texts):
            if self.plain(t):
                mine = self.split(t)
                pieces += mine
                where.append(i)
                counts.append(len(mine))
            else:
                out[i] = np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, dtype=np.uint32)
        rows = self.lookup(pieces)
        size = self.size[rows]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.first[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        for i, a, b in zip(where, bounds[:-1], bounds[1:], strict=True):
            out[i] = flat[a:b]
        return out


def blocks(texts: list[str], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; one text is never cut."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            out.append((at, i + 1))
            at, size = i + 1, 0
    return [*out, (at, len(texts))] if at < len(texts) else out
