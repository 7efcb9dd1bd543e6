"""Encoding batches of texts through their distinct chunks.

Texts are lower-cased and cut at white space by Arrow's own kernels, the distinct
chunks of a batch are found by Arrow's dictionary encoding, only chunks that a worker
does not remember are encoded (by a function the caller gives), and the ids of the
texts are gathered from the chunks' ids in numpy.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skysurvey.llm.bpe import SAFE_LAST, Merger, WordSplitter, has_odd_space, is_plain

#: Entries of a generation of a worker's table of chunks, and the longest chunk kept.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64
#: Characters of the texts that are encoded together.
GROUP_CHARS = 8_000_000


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of flat[starts[i] : starts[i] + sizes[i]] for all i."""
    if not len(sizes):
        return flat[:0]
    total = np.cumsum(sizes)
    at = np.arange(total[-1])
    at += np.repeat(starts - (total - sizes), sizes)
    return flat[at]


class ChunkEncoder:
    """Ids of whole texts by the word tokenizer; ``learn`` gives the ids of chunks without white space."""

    def __init__(self, merger: Merger, learn: Callable[[list[str]], list[bytes]]):
        self.merger = merger
        self.splitter = WordSplitter(merger)
        self.learn = learn
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of the chunks, as bytes; new ones are learned."""
        recent, older = self.recent, self.older
        found = [recent.get(c) for c in chunks]
        missing = [c for c, x in zip(chunks, found) if x is None]
        new = [c for c in missing if c not in older]
        learned = dict(zip(new, self.learn(new)))
        fresh = {c: older[c] if c in older else learned[c] for c in missing}
        recent.update((c, x) for c, x in fresh.items() if len(c) <= CACHE_CHARS)
        # Two generations: what a generation's time did not use is forgotten.
        if len(recent) >= CACHE_ENTRIES:
            self.older, self.recent = recent, {}
        return [fresh[c] if x is None else x for c, x in zip(chunks, found)]

    def _simple(self, text: str) -> bool:
        """Whether Arrow's kernels cut and lower the text as the library does."""
        return text.isascii() and "<|" not in text and not has_odd_space(text)

    def _latin(self, text: str) -> bool:
        return "<|" not in text and is_plain(text) and not has_odd_space(text)

    def _unusual(self, text: str) -> np.ndarray:
        """Ids of a text with special strings or code points beyond the plain ones."""
        parts = []
        for special, part in self.merger.segments(text):
            if special:
                parts.append(np.array([self.merger.special[part]], "<u4").tobytes())
            else:
                chunks = self.splitter.chunks(part)
                parts.extend(self._known(self.splitter.words(part) if chunks is None else chunks))
        return np.frombuffer(b"".join(parts), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of every text)."""
        out, sizes = [], []
        rows = texts.to_pylist()
        at = 0
        while at < len(rows):
            to, size = at, 0
            while to < len(rows) and (to == at or size + len(rows[to]) <= GROUP_CHARS):
                size += len(rows[to])
                to += 1
            ids, n = self._group(rows[at:to])
            out.append(ids)
            sizes.append(n)
            at = to
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        usual: list[str | None] = []
        for text in texts:
            if self._simple(text):
                usual.append(text)
            elif self._latin(text):
                usual.append(unicodedata.normalize("NFC", text).lower())
            else:
                usual.append(None)
        lowered = pc.ascii_lower(pa.array(usual, pa.large_string()))
        # A stop or comma after a letter is always a word of its own: fewer distinct chunks.
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, "([a-z])([.,])([ \n])", "\\1 \\2\\3"))
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode() if len(lists) else None
        words = coded.dictionary.to_pylist()
        empty = words.index("") if "" in words else -1
        known = [b"" if w == "" else None for w in words] if empty >= 0 else None
        values = self._known([w for w in words if w]) if empty >= 0 else self._known(words)
        if known is not None:
            rest = iter(values)
            values = [b"" if k is not None else next(rest) for k in known]
        flat = np.frombuffer(b"".join(values), "<u4")
        n = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(n) - n
        which = coded.indices.to_numpy()
        ids = ragged(flat, starts[which], n[which])
        ends = np.concatenate([[0], np.cumsum(n[which])])
        sizes = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]
        if None not in usual:
            return ids, sizes
        parts, low = [], 0
        for i, text in enumerate(usual):
            if text is None:
                parts.append(self._unusual(texts[i]))
                sizes[i] = len(parts[-1])
            else:
                parts.append(ids[low : low + sizes[i]])
                low += sizes[i]
        return np.concatenate(parts), sizes


def byte_letters() -> dict[str, str]:
    """Of the letters of the plain code points, what the tokenizer's byte-level alphabet writes for their UTF-8 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {ch: "".join(alphabet[b] for b in ch.encode()) for ch in map(chr, range(SAFE_LAST + 1)) if ch.isalpha()}


class LibraryLearner:
    """Ids of chunks by the tokenizer library: chunks of letters are one word each for its model, others go through all its steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The chunks are normalised already.
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.word = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        rest: list[int] = []
        word, letters = self.word, self.letters
        for i, c in enumerate(chunks):
            if c.isalpha() and (c.isascii() or all(x in letters for x in c)):
                found = word(c if c.isascii() else "".join([letters[x] for x in c]))
                out.append(array("I", [t.id for t in found]).tobytes())
            else:
                rest.append(i)
                out.append(b"")
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out
