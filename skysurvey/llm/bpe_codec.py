"""BPE encoding and decoding by prefix-sharing trie traversal.

Method: the distinct words of a batch go into a trie in sorted order and are walked
depth first. For each prefix the walk keeps one state, the last token of the prefix's
encoding, and words that share a prefix share its states. The last token of a prefix
is the one vocabulary string that ends it and may follow the last token of what
precedes it; "may follow" means that merging the two tokens' symbols gives the two
tokens back, and is kept in a bounded table. Reading the states backwards gives a
word's ids, so the encoding of a shared prefix is computed once.

Defined results: null and empty text have no tokens and decode to the empty string;
special strings inside a text become their ids, as the library does by default; texts
of any length are encoded whole; repeated rows are encoded each; an empty table gives
an empty result; only the key and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysurvey.llm.bpe import Merger, WordSplitter, default_path, shown
from skysurvey.llm.common import map_columns, text_input

#: Entries of a generation of a worker's table of encoded chunks, and of its table of token pairs.
CACHE_ENTRIES = 150_000
PAIR_ENTRIES = 400_000
CACHE_CHARS = 64
#: Characters of the texts that are encoded together.
GROUP_CHARS = 6_000_000


class TrieEncoder:
    """Encodes sets of words, sharing the work on their common prefixes."""

    def __init__(self, merger: Merger):
        self.merger = merger
        self.ids = merger.ids
        self.mark = merger.suffix
        whole = {t for t in merger.ids if self._self_encoding(t)}
        #: Tokens inside a word and at a word's end, by their visible characters.
        cut = len(self.mark)
        self.inner = {t: merger.ids[t] for t in whole if not t.endswith(self.mark)}
        self.final = {t[:-cut]: merger.ids[t] for t in whole if t.endswith(self.mark)}
        self.text_of = {i: t for t, i in merger.ids.items()}
        #: The longest final token by its last three characters.
        self.longest: dict[str, int] = {}
        for token in self.final:
            self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
        #: For every prefix of an inner token: the inner tokens that end it, longest first.
        self.tails: dict[str, tuple[tuple[int, int], ...]] = {}
        for token in self.inner:
            for end in range(len(token), 0, -1):
                prefix = token[:end]
                if prefix in self.tails:
                    break
                self.tails[prefix] = tuple((self.inner[x], len(x)) for at in range(end) if (x := prefix[at:]) in self.inner)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        cut = len(self.mark)
        if token.endswith(self.mark):
            bare = list(token[:-cut])
            return [*bare[:-1], bare[-1] + self.mark] if bare else []
        return list(token)

    def _self_encoding(self, token: str) -> bool:
        parts = self._symbols(token)
        return bool(parts) and all(p in self.ids for p in parts) and self.merger.merge(parts) == [token]

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self.text_of[a], self.text_of[b]
            known = self.merger.merge(self._symbols(left) + self._symbols(right)) == [left, right]
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            self.pairs[(a, b)] = known
        return known

    def _final(self, word: str, states: list[int]) -> tuple[int, int]:
        """The last token, and its length, of the encoding of a whole word."""
        end = len(word)
        for size in range(min(end, self.longest.get(word[-3:], 2)), 0, -1):
            token = self.final.get(word[end - size :])
            if token is not None and (size == end or self._may_follow(states[end - size], token)):
                return token, size
        raise ValueError(f"no encoding of {word!r}")

    def encode(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of every word (given in the vocabulary's printable alphabet)."""
        out: dict[str, tuple[int, ...]] = {}
        before = ""
        # By depth, along the trie's path to the current word: the last token, its length, and
        # the length of the longest end of the prefix that begins some token.
        states, sizes, reach = [-1], [0], [0]
        tails, pairs, may_follow = self.tails, self.pairs, self._may_follow
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            shared = min(shared, len(states) - 1)
            del states[shared + 1 :], sizes[shared + 1 :], reach[shared + 1 :]
            far = reach[shared]
            for end in range(shared + 1, len(word)):
                far += 1
                while (tail := tails.get(word[end - far : end])) is None:
                    far -= 1
                for token, size in tail:
                    if size == end or ((ok := pairs.get((states[end - size], token))) is None and may_follow(states[end - size], token)) or ok:
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
                states.append(token)
                sizes.append(size)
                reach.append(far)
            token, size = self._final(word, states)
            ids, at = [token], len(word) - size
            while at:
                ids.append(states[at])
                at -= sizes[at]
            out[word] = tuple(reversed(ids))
            before = word
        return out


class Codec:
    """Encodes and decodes texts with the word tokenizer file."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.trie = TrieEncoder(self.merger)
        self.splitter = WordSplitter(self.merger)
        self.special = self.merger.special
        self.strings = {i: t for t, i in (*self.merger.ids.items(), *self.special.items())}
        self.recent: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _split(self, text: str) -> list[str]:
        """The text as chunks: specials and words or white-space delimited chunks of words.

        A chunk starting with a blank is a special string; no other chunk has white space.
        """
        out: list[str] = []
        for special, part in self.merger.segments(text):
            if special:
                out.append(" " + part)
            else:
                chunks = self.splitter.chunks(part)
                out.extend(self.splitter.words(part) if chunks is None else chunks)
        return out

    def _learn(self, missing: set[str]) -> dict[str, tuple[bytes, str]]:
        words = {c: [shown(w) for w in self.splitter.find(c)] for c in missing if c[0] != " "}
        coded = self.trie.encode({w for ws in words.values() for w in ws})
        out: dict[str, tuple[bytes, str]] = {}
        for chunk in missing:
            if chunk[0] == " ":
                ids: list[int] = [self.special[chunk[1:]]]
            else:
                ids = [i for w in words[chunk] for i in coded[w]]
            out[chunk] = (pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]))
        return out

    def batches(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """Per text its list of encoded chunks: (ids as bytes, decoded text)."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_CHARS):
                group.append(self._split(texts[at]))
                size += len(texts[at])
                at += 1
            distinct = set().union(*group)
            known = {c: x for c in distinct if (x := self.recent.get(c) or self.older.get(c))}
            known.update(self._learn(distinct.difference(known)))
            # Two generations: what a generation's time did not use is forgotten.
            self.recent.update((c, x) for c, x in known.items() if len(c) <= CACHE_CHARS)
            if len(self.recent) >= CACHE_ENTRIES:
                self.older, self.recent = self.recent, {}
            get = known.__getitem__
            for chunks in group:
                yield list(map(get, chunks))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        return [b"".join([c[0] for c in coded]) for coded in self.batches(texts)]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of ids with special tokens kept: token strings joined by blanks."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", path: str | None = None, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256; with full also ids and decoded."""
    kind = docs.schema[key].dataType.simpleString()
    slim = text_input(docs, key, text=text).select(F.col(key).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, id_hashes, text_hashes, all_ids, all_texts = [], [], [], [], []
        for coded in codec(path or default_path(vocabulary)).batches(batch.column(1).to_pylist()):
            ids = b"".join([c[0] for c in coded])
            decoded = " ".join([c[1] for c in coded if c[0]])
            counts.append(len(ids) // 4)
            id_hashes.append(hashlib.sha256(ids).hexdigest())
            text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
            if full:
                all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                all_texts.append(decoded)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return map_columns(slim, schema, run).withColumnRenamed("key", key)
