"""Removal of repeated byte strings by sparse distributed prefix doubling.

Every byte covered by a string of ``threshold`` bytes that also starts earlier (in a
document with a smaller key, or earlier in the same one) is removed.

Prefix doubling ranks the strings of length 2n by the pair of ranks of their halves:
Spark sorts (rank, rank at the offset, position), equal pairs get one rank, positions
with a rank of their own drop out, and the offset grows until it is past the threshold.
Sorting starts here where strings can be unique; before, five doublings name all strings
of up to 32 bytes where the text lies.

1. Every window of ``threshold`` bytes is represented by the smallest 32-byte name in
   it (leftmost among equals). Equal windows have equal representatives, and
   neighbouring windows mostly share one, so one run of windows in about 35 positions
   stands for all.
2. Spark sorts the runs' pairs by (name of 32 bytes, name of the run's whole string, position).
   Runs whose first name is unique drop out. Of runs with equal pairs all but the first
   are repeats as a whole; if a name has one pair only, its first run is no repeat.
   What remains are runs that share 32 bytes but differ further on, such as those at the
   edge of a copied passage.
3. Of these, Spark sorts the pairs of every window, (rank of 32 bytes, name at the offset
   that reaches the threshold, position): every window but the first of a pair is a repeat.

Both sorts are by ranges of the whole key, position included, so a string that a third of
all rows hold is spread over many tasks. A task settles the groups that lie inside its
range; those at its ends are settled by a second, small aggregation.

A pair has 64 + 64 bits. Texts move twice: those with unsettled windows to them, and all
to the ranges that they lose.

Defined results: null and empty text keeps nothing and has nothing removed; texts
shorter than the threshold are kept whole; rows that repeat both key and text count as
one document and get the same result each, rows that repeat only the key are ordered by
a hash of their text; null keys come last; an empty table gives an empty result; only
the key and the text are read, and other columns may have any name. The key must be an
integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skysurvey.llm.common import discard, numbered, partitions, positional, prepare, slices, trim, written

THRESHOLD = 100
GRAM = 32
#: Positions named at a time; also the range of a position inside a packed name.
CHUNK = 1 << 16
#: Bytes of text and windows for each task of a sort, about.
SORT_BYTES = 16_000_000
SORT_WINDOWS = 400_000
#: Bytes of text that a Python worker turns into runs or into what is left at a time, and windows that it names at a time.
SLICE_BYTES = 2_000_000
SLICE_WINDOWS = 100_000
#: Rows of a file of spans, so that the windows of a task's files, about 40 for each span, stay few.
SPAN_ROWS = 20_000

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(1, 2**62, 16).astype(np.uint64) * np.uint64(4) + np.uint64(3)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _pair(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """The name of a pair of names."""
    out = left * _MULTIPLY[level]
    out += right
    out ^= out >> _S29
    out *= _MULTIPLY[level + 8]
    out ^= out >> _S32
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Names of the 32-byte strings at every position, by five doublings."""
    names = _BYTE[data]
    size = 1
    for level in range(5):
        names = _pair(names[:-size], names[size:], level)
        size *= 2
    return names


def _windows(names: np.ndarray, at: np.ndarray, size: int, level: int) -> np.ndarray:
    """windows() at a level. No inner function of it: one that calls itself is a cycle that keeps names until Python collects its garbage."""
    if size == GRAM:
        return names[at]
    half = GRAM
    while half * 2 < size:
        half *= 2
    return _pair(_windows(names, at, half, level - 1), _windows(names, at + (size - half), half, level - 1), min(level, 7))


def windows(names: np.ndarray, at: np.ndarray, threshold: int) -> np.ndarray:
    """Names of the threshold-byte strings at the given positions: pairs at growing offsets, the last one overlapping."""
    size, level = GRAM, 5
    while size < threshold:
        size, level = size * 2, level + 1
    return _windows(names, at, threshold, level)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbouring values."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - size : width - size + n])
    return out


def chunk_runs(data: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a representative: (name, span's name, start, windows, several representatives).

    data holds texts one after the other, at most CHUNK bytes; ends are the places where they end.
    """
    width = threshold - GRAM + 1
    n = len(data) - threshold + 1
    if n <= 0:
        return tuple(np.zeros(0, np.uint64) for _ in range(5))
    names = grams(data)
    packed = names & ~np.uint64(0xFFFF)
    packed |= np.arange(len(packed), dtype=np.uint64)
    low = smallest(packed, width)
    name = names[(low & np.uint64(0xFFFF)).astype(np.int64)]
    # A window lies inside a text if the text's end is far enough.
    limit = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:n]
    inside = np.arange(n) + threshold <= limit
    turn = np.ones(n, bool)
    turn[1:] = (name[1:] != name[:-1]) | (limit[1:] != limit[:-1]) | (inside[1:] != inside[:-1])
    start = np.nonzero(turn)[0]
    size = np.diff(np.append(start, n))
    moved = np.concatenate([[0], np.cumsum(low[1:] != low[:-1])])
    several = moved[start + size - 1] != moved[start]
    keep = inside[start]
    start, size, several = start[keep], size[keep], several[keep]
    if len(size) and size.max() > threshold:  # the span's name covers at most so many windows
        pieces = -(-size // threshold)
        order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size, several = (np.repeat(x, pieces) for x in (start, size, several))
        start = start + order * threshold
        size = np.minimum(size - order * threshold, threshold)
    span = _pair(windows(names, start, threshold), windows(names, start + size - 1, threshold), 7) + size.astype(np.uint64)
    return name[start], span, start, size, several


def text_chunks(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row of each text, place of each text's first byte in it) of at most CHUNK bytes."""
    step = CHUNK - threshold + 1
    group: list[bytes] = []
    rows: list[int] = []
    places: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - threshold + 1, 0), step):
            piece = text[at : at + CHUNK]
            if size + len(piece) > CHUNK:
                yield np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(g) for g in group]), np.array(rows), np.array(places)
                group, rows, places, size = [], [], [], 0
            group.append(piece)
            rows.append(row)
            places.append(at)
            size += len(piece)
    if group:
        yield np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(g) for g in group]), np.array(rows), np.array(places)


def text_runs(texts: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    """(name, span, row, start in the text, windows, several) of all runs of the texts."""
    found = []
    for data, ends, rows, places in text_chunks(texts, threshold):
        name, span, start, size, several = chunk_runs(data, ends, threshold)
        piece = np.searchsorted(ends, start, "right")
        begin = np.concatenate([[0], ends[:-1]])
        found.append((name, span, rows[piece] if len(piece) else piece, start - begin[piece] + places[piece], size, several))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns is the first with its values."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


#: What a sort finds of a run: a repeat as a whole, one to be told apart by windows, one that other tasks decide on (and with several representatives), one that they need to know of.
REPEAT, VARIANT, EDGE, EDGE_SEVERAL, FACT = 1, 2, 3, 4, 5
_RUN_SQL = "name bigint, span bigint, doc bigint, start bigint, size int, several boolean"
_RANKED_SQL = "name bigint, span bigint, doc bigint, start bigint, size int, status int"


def named_runs(texts: DataFrame, threshold: int) -> DataFrame:
    """Step 1: the runs of (doc, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            name, span, row, start, size, several = text_runs(batch.column(1).to_pylist(), threshold)
            made = [name.view(np.int64), span.view(np.int64), docs[row] if len(row) else row.astype(np.int64), start.astype(np.int64), size.astype(np.int32), several.astype(bool)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["name", "span", "doc", "start", "size", "several"])
            del name, span, row, start, size, several, made
            trim()

    return texts.mapInArrow(run, _RUN_SQL)


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """A task's sorted rows, by column."""
    found = list(batches)
    return [c.to_numpy() for c in pa.Table.from_batches(found).columns] if found else []


def ranked_runs(runs: DataFrame, tasks: int) -> DataFrame:
    """Step 2: runs that repeat or are to be told apart, and a few at the ends of each task's range.

    Of the groups that may go on in other tasks only two runs are open: the task's first run,
    which may repeat one of the task before, and the first run of its last group, if that
    has one span here but may have others in the next task. Other tasks need to know of the
    first run of both groups, and the first run of their last span.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches)
        if not columns or not len(columns[0]):
            return
        name, span, doc, start, size, several = columns
        head = np.nonzero(first_of_groups(name))[0]
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(name))))
        first = first_of_groups(name, span)
        mixed = (np.add.reduceat(first.astype(np.int64), head) > 1)[group]
        status = np.where(first, np.where(several | mixed, VARIANT, 0), REPEAT)
        begins = np.nonzero(first)[0]
        last_span = begins[np.searchsorted(begins, np.append(head[1:], len(name))) - 1]
        open_ = np.array([0] if mixed[head[-1]] else sorted({0, int(head[-1])}))
        status[open_] = np.where(several[open_], EDGE_SEVERAL, EDGE)
        facts = np.unique([head[0], head[-1], last_span[0], last_span[-1]])
        rows = np.concatenate([np.nonzero(status)[0], facts])
        status = np.concatenate([status[status > 0], np.full(len(facts), FACT)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in (name, span, doc, start, size)), pa.array(status)], ["name", "span", "doc", "start", "size", "status"])
        trim()

    keys = ["name", "span", "doc", "start"]
    return runs.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(scan, _RANKED_SQL)


def settled_runs(ranked: DataFrame) -> DataFrame:
    """Step 2: (doc, start, size, status, name) with the open runs of all tasks settled."""
    place = F.struct("doc", "start")
    facts, ends = ranked.filter(F.col("status") == FACT), ranked.filter(F.col("status").isin(EDGE, EDGE_SEVERAL))
    mixed = facts.groupBy("name").agg((F.min("span") != F.max("span")).alias("mixed"))
    leads = facts.groupBy("name", "span").agg(F.min(place).alias("lead"))
    status = F.when(place > F.col("lead"), REPEAT).when(F.col("mixed") | (F.col("status") == EDGE_SEVERAL), VARIANT).otherwise(0)
    rest = ends.join(leads, ["name", "span"]).join(mixed, "name").withColumn("status", status).filter("status > 0")
    columns = ["doc", "start", "size", "status", "name"]
    return ranked.filter(F.col("status") < EDGE).select(*columns).unionByName(rest.select(*columns))


def variant_spans(texts: DataFrame, settled: DataFrame, threshold: int) -> DataFrame:
    """(name, doc, start, size, span) of the runs that have to be told apart, with their bytes."""
    variants = settled.filter(F.col("status") == VARIANT).groupBy("doc").agg(F.collect_list(F.struct("name", "start", "size")).alias("runs"))

    def span(r: Column) -> Column:
        bytes_ = F.substring(F.col("text"), (r["start"] + 1).cast("int"), r["size"] + F.lit(threshold - 1))
        return F.struct(r["name"].alias("name"), r["start"].alias("start"), r["size"].alias("size"), bytes_.alias("span"))

    return texts.join(variants, "doc").select("doc", F.explode(F.transform("runs", span)).alias("r")).select("r.name", "doc", "r.start", "r.size", "r.span")


def window_batches(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(name, window, doc, place) of every window of spans of at most ``threshold`` windows each, about SLICE_WINDOWS at a time."""
    rows = max(SLICE_WINDOWS // threshold, 1)
    for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
        size = batch.column(3).to_numpy().astype(np.int64)
        data = batch.column(4).to_pylist()
        begin = np.cumsum([0, *map(len, data)])[:-1]
        order = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(begin, size) + order
        window = windows(grams(np.frombuffer(b"".join(data), np.uint8)), at, threshold) if len(at) else np.zeros(0, np.uint64)
        made = [np.repeat(batch.column(0).to_numpy(), size), window.view(np.int64), np.repeat(batch.column(1).to_numpy(), size), np.repeat(batch.column(2).to_numpy(), size) + order]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["name", "window", "doc", "place"])
        del size, data, begin, order, at, window, made
        trim()


def span_windows(spans: DataFrame, threshold: int) -> DataFrame:
    """Step 3: (name, window, doc, place) of every window of the spans."""
    return spans.mapInArrow(lambda batches: window_batches(batches, threshold), "name bigint, window bigint, doc bigint, place bigint")


def _ranges(doc: np.ndarray, place: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal byte ranges (doc, low, high) covered by windows."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > threshold)
    last = np.append(first[1:], True)[: len(doc)]
    return doc[first], place[first], place[last] + threshold


#: Rows of step 3: a range, the first window of a task, and the first of its last group.
_RANGE, _HEAD, _LEAD = 0, 1, 2
_RANGES_SQL = "kind int, name bigint, window bigint, doc bigint, low bigint, high bigint"


def ranked_windows(found: DataFrame, tasks: int, threshold: int) -> DataFrame:
    """Step 3: the byte ranges of windows that are not the first of their pair, and the ends of tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _columns(batches)
        if not columns or not len(columns[0]):
            return
        name, window, doc, place = columns
        first = first_of_groups(name, window)
        again, low, high = _ranges(doc[~first], place[~first], threshold)
        ends = np.array([0, np.nonzero(first)[0][-1]])
        none = np.zeros(len(again), np.int64)
        made = [(none, [_HEAD, _LEAD]), (none, name[ends]), (none, window[ends]), (again, doc[ends]), (low, place[ends]), (high, place[ends] + threshold)]
        kinds = [pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), k) if k == pa.int64() else pa.array(np.concatenate(x).astype(np.int32)) for x, k in zip(made, kinds)], ["kind", "name", "window", "doc", "low", "high"])
        trim()

    keys = ["name", "window", "doc", "place"]
    return found.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(scan, _RANGES_SQL)


def settled_ranges(ranked: DataFrame) -> DataFrame:
    """Step 3: (doc, low, high), the first windows of tasks settled."""
    place = F.struct("doc", "low")
    leads = ranked.filter(F.col("kind") == _LEAD).groupBy("name", "window").agg(F.min(place).alias("lead"))
    again = ranked.filter(F.col("kind") == _HEAD).join(leads, ["name", "window"]).filter(place > F.col("lead"))
    columns = ["doc", "low", "high"]
    return ranked.filter(F.col("kind") == _RANGE).select(*columns).unionByName(again.select(*columns))


def _kept(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes outside the ranges, number of bytes in them, number of maximal ranges)."""
    parts, gone, spans, at = [], 0, 0, -1
    for low, high in sorted(ranges):
        if low > at:
            parts.append(data[max(at, 0) : low])
            spans += 1
            gone += high - low
            at = high
        elif high > at:
            gone += high - at
            at = high
    parts.append(data[max(at, 0) :])
    return b"".join(parts), gone, spans


def repeated_ranges(texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, low, high): the byte ranges of (doc, text as bytes) that are repeats; doc is unique."""
    spark = texts.sparkSession
    prepare(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = written(named_runs(texts, threshold), "suffix-runs")
    ranked = written(ranked_runs(runs, max(partitions(spark), -(-size // SORT_BYTES))), "suffix-ranked")
    discard(runs)
    settled = settled_runs(ranked)
    spans = written(variant_spans(texts, settled, threshold), "suffix-spans", SPAN_ROWS)
    several = spans.agg(F.sum("size")).first()[0] or 0
    ranges = written(ranked_windows(span_windows(spans, threshold), max(partitions(spark), -(-several // SORT_WINDOWS)), threshold), "suffix-windows")
    discard(spans)
    whole = settled.filter(F.col("status") == REPEAT).select("doc", F.col("start").alias("low"), (F.col("start") + F.col("size") + F.lit(threshold - 1)).alias("high"))
    return whole.unionByName(settled_ranges(ranges))


def _deduped(docs: DataFrame, key: str, text: str, full: bool) -> tuple[DataFrame, list[str]]:
    """(c0, c1, ... for the key and, with full, the other columns; n_bytes, n_removed, n_spans, kept_sha256, kept), and the columns' names in docs."""
    flat, (c_key, c_text) = positional(docs, key, text)
    columns = [c_key, *(c for c in flat.columns if full and c not in (c_key, c_text))]
    base, same = numbered(flat, c_key, c_text)
    data = F.coalesce(F.col(c_text).cast("string"), F.lit("")).cast("binary")
    base = base.select(*columns, F.col("_doc").alias("doc"), data.alias("text"))
    texts = base.select("doc", "text")
    ranges = repeated_ranges(texts if same else texts.dropDuplicates(["doc"]))
    ranges = ranges.groupBy("doc").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    rows = base.join(ranges, "doc", "left").select(*columns, "text", "lows", "highs")
    n = len(columns)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if full else [])]
    schema = ", ".join([*(f"{c} {flat.schema[c].dataType.simpleString()}" for c in columns), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *(["kept string"] if full else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, n, SLICE_BYTES)):
            out: list[tuple] = []
            for row, lows, highs in zip(*(batch.column(n + i).to_pylist() for i in range(3))):
                kept, gone, spans = _kept(row, list(zip(lows or [], highs or [])))
                out.append((len(row), gone, spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if full else [])))
            found = [pa.array(x, k) for x, k in zip(zip(*out), (*[pa.int64()] * 3, *[pa.string()] * 2))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n)), *found], [*columns, *made])
            del out, found
            trim()

    return rows.mapInArrow(finish, schema), [docs.columns[int(c[1:])] for c in columns]


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256.

    With full the key and the other columns of docs, n_bytes, n_removed, n_spans,
    kept_sha256 and kept, the text that is left (characters that a removal cut in two are
    dropped).
    """
    found, names = _deduped(docs, key, text, full)
    return found.toDF(*names, *found.columns[len(names) :])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs, all columns, with the text that is left and its length; rows with nothing left are dropped."""
    found, names = _deduped(docs, key, text, True)
    left = found.filter("n_bytes > n_removed")
    place = {name: F.col(c) for name, c in zip(names, found.columns)} | {text: F.col("kept")}
    if size in docs.columns:
        place[size] = F.length("kept").cast(docs.schema[size].dataType)
    return left.select(*[place[c].alias(c) for c in docs.columns])
