"""Byte-pair vocabularies read from a tokenizer file, merging, and exact pre-tokenizing.

Splitting a text into pre-tokens is done here only for code points up to
``SAFE_LAST``, where Python's and the library's character classes agree (a test
compares them for each of those code points); other texts are normalised and
split by the library's own components, so results never depend on the Unicode
version of either.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex

#: Last code point of Latin Extended-B.
SAFE_LAST = 0x24F
_UNSAFE = re.compile(f"[^\\x00-{chr(SAFE_LAST)}]")
#: White space that str.split() and the pre-tokenizers' patterns may see differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")

#: The pre-token patterns of the two tokenizer files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


_ALPHABET = byte_alphabet()
_TRANSLATE = {b: _ALPHABET[b] for b in range(256)}


def shown(piece: str) -> str:
    """The bytes of a piece in the vocabulary's printable alphabet."""
    return piece.encode("utf-8", "replace").decode("latin-1").translate(_TRANSLATE)


class Merger:
    """Vocabulary and merge order of one byte-pair tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None

    @property
    def library(self):
        """The tokenizer library's object; its normaliser and splitter serve the unusual texts."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def symbols(self, piece: str) -> list[str]:
        """The starting symbols of a piece; the last one carries the end-of-word mark."""
        out = list(shown(piece))
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank first and leftmost among equals."""
        if len(parts) > 48:
            return self._merge_long(parts)
        ranks = self.ranks
        parts = list(parts)
        far = len(ranks)
        scores = [ranks.get(p, far) for p in zip(parts, parts[1:])]
        while scores:
            low = min(scores)
            if low == far:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get((parts[i], parts[i + 1]), far)
            if i:
                scores[i - 1] = ranks.get((parts[i - 1], parts[i]), far)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """As merge, with a heap over linked symbols: n log n for pieces of any length."""
        ranks = self.ranks
        n = len(parts)
        word: list[str | None] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j >= n or word[j] != b:
                continue
            word[i], word[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((word[i], word[k]))) is not None:
                    heapq.heappush(heap, (r, i, (word[i], word[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get((word[h], word[i]))) is not None:
                heapq.heappush(heap, (r, h, (word[h], word[i])))
        return [w for w in word if w is not None]

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (is special, string), empty strings left out."""
        if self.special_pattern is None or "<|" not in text and not self.special_pattern.search(text):
            return [(False, text)] if text else []
        return [(i % 2 == 1, s) for i, s in enumerate(self.special_pattern.split(text)) if s]


def is_plain(text: str) -> bool:
    """Whether Python's character classes may be used on the text."""
    return text.isascii() or not _UNSAFE.search(text)


def has_odd_space(text: str) -> bool:
    return bool(_ODD_SPACE.search(text))


class WordSplitter:
    """Lower-cased words of the word tokenizer, exactly as the library normalises and splits."""

    def __init__(self, merger: Merger):
        self.merger = merger
        self.find = regex.compile(WORD_PATTERN).findall

    def chunks(self, segment: str) -> list[str] | None:
        """White-space separated chunks of the normalised segment; None if the library has to split it."""
        if not is_plain(segment) or has_odd_space(segment):
            return None
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment)
        return segment.lower().split()

    def words(self, segment: str) -> list[str]:
        """The words of any segment by the library's normaliser and splitter."""
        library = self.merger.library
        normal = library.normalizer.normalize_str(segment)
        return [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)]
