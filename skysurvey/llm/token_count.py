"""Token counts of whole texts by the whole-token shortcut.

Method: a table made once from the vocabulary proves which of its strings are cut
out whole by the pre-tokenizer and encode alone as a single token; pre-tokens in
that table count one without any merging, and only the rest is merged. Counts of
white-space delimited chunks are kept in a bounded table of each Python worker.

Defined results: null or empty text has 0 bytes and 0 tokens; texts of any length
are counted whole; repeated rows are counted each; an empty table gives an empty
result; of the input only the key and the text column are read, so extra columns
with any names do not matter; a null key stays null.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from skysurvey.llm.bpe import BYTE_LEVEL_PATTERN, Merger, default_path, has_odd_space, is_plain
from skysurvey.llm.common import map_columns, text_input

#: Entries of a generation of a worker's table of counted chunks.
CACHE_ENTRIES = 300_000
#: Characters of the texts whose chunks are counted together.
GROUP_CHARS = 8_000_000
#: Longer chunks are counted but not kept.
CACHE_CHARS = 64

_WIDE_SPACE = re.compile(r"\s\s")


class TokenCounter:
    """Counts tokens as the byte-level tokenizer file gives them."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.find = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.whole = self._whole_tokens()
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.joined = Tokenizer.from_file(path)
        self.joined.no_truncation()
        self.joined.no_padding()
        self.joined.encode_special_tokens = True
        self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that the pre-tokenizer leaves whole and the merges make one token."""
        back = {ord(c): b for b, c in enumerate(self._alphabet())}
        proved = []
        for token in self.merger.ids:
            try:
                raw = bytes(back[ord(c)] for c in token).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if is_plain(raw) and self.find(raw) == [raw] and self.merger.merge(self.merger.symbols(raw)) == [token]:
                proved.append(raw)
        return frozenset(proved)

    @staticmethod
    def _alphabet() -> list[str]:
        from skysurvey.llm.bpe import byte_alphabet

        return byte_alphabet()

    def _merged(self, pieces: list[str]) -> list[int]:
        """Token counts of pre-tokens outside the table: one merging run over all of them."""
        joined = [p for p in pieces if "\0" not in p]
        counts: dict[str, int] = {}
        if joined:
            words = np.array(self.joined.encode("\0".join(joined), add_special_tokens=False).word_ids)
            counts.update(zip(joined, np.bincount(words, minlength=len(joined)).tolist()))
        return [counts[p] if p in counts else len(self.merger.merge(self.merger.symbols(p))) for p in pieces]

    def _units(self, text: str) -> list[str]:
        """Strings whose counts add up to the text's, cut where no pre-token can cross."""
        if not is_plain(text):
            return [text]
        if has_odd_space(text) or _WIDE_SPACE.search(text):
            return self.find(text)
        # Every run of white space is one character here, so a blank belongs to what follows it
        # and no pre-token crosses the place before a blank.
        head, *rest = text.split(" ")
        units = [" " + c for c in rest]
        if head:
            units.append(head)
        return units

    def _pieces(self, unit: str) -> list[str]:
        if is_plain(unit):
            return self.find(unit)
        return [unit[a:b] for _, (a, b) in self.merger.library.pre_tokenizer.pre_tokenize_str(unit)]

    def _learn(self, units: set[str]) -> dict[str, int]:
        cut = {u: self._pieces(u) for u in units}
        rest = list({p for ps in cut.values() for p in ps}.difference(self.whole))
        counts = dict(zip(rest, self._merged(rest)))
        return {u: sum([counts.get(p, 1) for p in ps]) for u, ps in cut.items()}

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of every text."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            specials, groups, size = [], [], 0
            while at < len(texts) and (not groups or size + len(texts[at]) <= GROUP_CHARS):
                parts = self.merger.segments(texts[at])
                specials.append(sum(special for special, _ in parts))
                groups.append([u for special, part in parts if not special for u in self._units(part)])
                size += len(texts[at])
                at += 1
            distinct = set().union(*groups)
            known = {u: n for u in distinct if (n := self.recent.get(u) or self.older.get(u))}
            new = self._learn(distinct.difference(known))
            known.update(new)
            self._keep(known)
            get = known.__getitem__
            out.extend(n + sum(map(get, units)) for n, units in zip(specials, groups))
        return out

    def _keep(self, counts: dict[str, int]) -> None:
        """Two generations: what a generation's time did not use is forgotten."""
        self.recent.update((u, n) for u, n in counts.items() if len(u) <= CACHE_CHARS)
        if len(self.recent) >= CACHE_ENTRIES:
            self.older, self.recent = self.recent, {}

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str = "byte_bpe_50k.json", path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    kind = docs.schema[key].dataType.simpleString()
    slim = text_input(docs, key, text=text).select(F.col(key).alias("key"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        tokens = pa.array(counter(path or default_path(vocabulary)).count_all(texts.to_pylist()), pa.int64())
        sizes = pc.cast(pc.binary_length(texts), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    return map_columns(slim, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", run).withColumnRenamed("key", key)
