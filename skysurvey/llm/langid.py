"""Language identification by multinomial naive Bayes over hashed character n-grams.

Method: lower-cased text is cut into code points; every n-gram of one to four of them
is hashed into a fixed number of buckets; the model is a matrix of smoothed log
probabilities (languages by buckets) and a vector of log priors, broadcast to the
executors, and a batch of texts is scored as a product of its sparse count matrix and
that matrix, by gathers and segment sums in numpy.

The model is fitted on about ``fit_rows`` labelled rows, in equal shares by language and
chosen by the xxhash64 of their key. Their whole texts are counted in the executors; the
counts by language and bucket are collected, whose number the matrix bounds. Priors are counted over all
labelled rows. Predictions read whole texts and never the key, the label or the source.

Defined results: null text, and text without any letter, gives ``und`` with score 0;
with no labelled row at all every text gives ``und`` with score 0; ties go to the
language that sorts first; repeated rows are predicted each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from skysurvey.llm.common import map_columns, positional, prepare

UNDETERMINED = "und"
#: Buckets of the hashed n-grams, and the longest n-gram.
BUCKETS = 1 << 17
LONGEST = 4
SMOOTHING = 0.5
#: Rows of the fitting sample, about.
FIT_ROWS = 6000
#: Characters scored at a time.
SLICE = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(0x9E3779B1)


def hashed_grams(text: str) -> list[np.ndarray]:
    """Buckets of the n-grams of a lower-cased text, one array for each length."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    found = []
    state = codes * _MIX
    for n in range(1, LONGEST + 1):
        if n > 1:
            state = (state[:-1] ^ (state[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * _MIX
        if not len(state):
            break
        mixed = (state ^ (state >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        found.append(mixed >> np.uint32(32 - 17))
    return found


class NaiveBayes:
    """Log probabilities of hashed n-grams by language."""

    def __init__(self, languages: list[str], priors: np.ndarray, table: np.ndarray):
        self.languages = languages
        self.priors = priors
        self.table = table  # buckets by languages, float32

    @classmethod
    def fit(cls, found: pa.Table | None, seen: dict[str, int]) -> NaiveBayes:
        """found: rows (label, bucket, n); seen: labelled rows by language."""
        languages = sorted(seen)
        place = {lang: k for k, lang in enumerate(languages)}
        counts = np.full((len(languages), BUCKETS), SMOOTHING)
        if found is not None:
            labels = found["label"].combine_chunks().dictionary_encode()
            rows = np.array([place[lang] for lang in labels.dictionary.to_pylist()], np.int64)[labels.indices.to_numpy(zero_copy_only=False)]
            np.add.at(counts, (rows, found["bucket"].to_numpy()), found["n"].to_numpy())
        table = np.log(counts / counts.sum(axis=1, keepdims=True)).T
        priors = np.log(np.array([seen[lang] for lang in languages], float) / max(1, sum(seen.values())))
        return cls(languages, priors, np.ascontiguousarray(table, np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its probability for every text."""
        chosen: list[str] = [UNDETERMINED] * len(texts)
        scores = [0.0] * len(texts)
        if not self.languages:
            return chosen, scores
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text is None or not _LETTER.search(text):
                continue
            group.append(i)
            size += len(text)
            if size >= SLICE:
                self._score(texts, group, chosen, scores)
                group, size = [], 0
        if group:
            self._score(texts, group, chosen, scores)
        return chosen, scores

    def _score(self, texts: list[str | None], group: list[int], chosen: list[str], scores: list[float]) -> None:
        lowered = [texts[i].lower() for i in group]
        # The texts are scored as one string, a slice at a time; n-grams that cross a text's end weigh nothing.
        joined = "".join(lowered)
        ends = np.cumsum([len(t) for t in lowered])
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(group), len(self.languages)))
        for low in range(0, len(joined), SLICE):
            high = min(low + SLICE, len(joined))
            first, past = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
            for n, grams in enumerate(hashed_grams(joined[low : high + LONGEST - 1]), 1):
                rows = self.table[grams[: high - low]]
                for e in ends[first:past] - low:
                    rows[max(e - n + 1, 0) : max(e, 0)] = 0
                at = np.maximum(starts[first:past] - low, 0)
                inside = at < len(rows)
                total[first:past][inside] += np.add.reduceat(rows, at[inside], axis=0, dtype=np.float64)
        total += self.priors
        best = total.argmax(axis=1)
        # A text's n-grams overlap; the evidence is tempered by their number of lengths.
        margin = (total - total.max(axis=1, keepdims=True)) / LONGEST
        sure = 1.0 / np.exp(margin).sum(axis=1)
        for i, b, p in zip(group, best.tolist(), sure.tolist()):
            chosen[i] = self.languages[b]
            scores[i] = min(1.0, p)


def bucket_counts(texts: Iterable[str]) -> np.ndarray:
    """Occurrences of every bucket in the n-grams of whole texts."""
    counts = np.zeros(BUCKETS, np.int64)
    waiting: list[np.ndarray] = []
    size = 0
    for text in texts:
        lowered = text.lower()
        for low in range(0, len(lowered), SLICE):
            high = min(low + SLICE, len(lowered))
            waiting += [grams[: high - low] for grams in hashed_grams(lowered[low : high + LONGEST - 1])]
            size += high - low
            if size >= SLICE:
                counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                waiting, size = [], 0
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
    return counts


def held_out(key: Column) -> Column:
    """Whether a row is kept out of the fitting: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", fit_rows: int = FIT_ROWS) -> NaiveBayes:
    """A model of the labelled rows that are not held out, on a sample of them."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(
        F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)).alias("place")
    )
    seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return NaiveBayes.fit(None, {})
    share = max(1, fit_rows // len(seen))
    shares = F.create_map(*(F.lit(x) for lang, n in seen.items() for x in (lang, int((1 << 40) * min(1.0, share / n)))))
    sample = labelled.filter(F.col("place") < F.element_at(shares, F.col("label"))).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(t)
            for lang, own in texts.items():
                counts = bucket_counts(own)
                buckets = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(counts[buckets], pa.int64())], ["label", "bucket", "n"])

    prepare(docs.sparkSession)
    found = sample.mapInArrow(run, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    return NaiveBayes.fit(found.toArrow(), seen)  # at most the languages times the buckets


def identify(docs: DataFrame, model: NaiveBayes, text: str = "text") -> DataFrame:
    """docs with its columns as c0, c1, ..., whatever their names, and lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.priors, model.table))
    flat, (c_text,) = positional(docs, text)
    at, names = flat.columns.index(c_text), [*flat.columns, "lang_pred", "score"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields), "lang_pred string", "score double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores = NaiveBayes(*shared.value).predict(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names)

    return map_columns(flat, schema, run)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: key, held_out, lang_pred and score."""
    model = fit(docs, key, text, label, fit_rows)
    found = identify(docs.select(key, text), model, text)
    return found.select(F.col("c0").alias(key), held_out(F.col("c0")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a score of at least ``least``."""
    found = identify(docs, fit(docs, key, text, label), text)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)
