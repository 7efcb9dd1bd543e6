"""Mixture-controlled packing of token sequences by deficit round-robin.

Method: every source is a queue of its documents' tokens. Sequence after sequence, each
queue gives as many tokens as its share of the sequence's length, and what rounding
withheld from or gave to it in advance (its deficit) is carried to the next sequence.
Queues stand in a fixed order and the running totals after queue i are
``floor(sum of the exact shares of queues 0..i)``, so a queue's deficit always lies
between -1 and 1, every sequence is full, and the state at any sequence has a closed
form: any partition can begin at any of its documents with the right deficits, without
passing through the sequences before it. When a queue runs out, its share goes to the
others in proportion (a new phase).

Without given targets the shares are the sources' shares of all tokens, so all queues
end in the last sequence. Sources too small to give one token to each sequence share
one queue, which bounds the number of queues by the sequence length. Inside that queue
they are dealt by a binary tree: of the first t tokens of a node of n tokens, its first
child of a tokens has given ``floor(t * a / n)`` and the second one the rest, so every
source is within a few tokens of its share at any place, and a token's place in the
queue follows from its place in its source by a division a level. The tree's upper
levels are over hashed buckets of sources, its lower ones are made in the executors.

Steps: tokens are written once, with their place in the partition's part of their
source; sums by (partition, source) give each part's place in its queue; a map over the
written tokens then cuts the documents. Only sums are shuffled.

Defined results: a null or empty text has the end token alone; a null source counts as
the empty one; rows that repeat are packed each; an empty table gives an empty result;
documents of any length are cut at sequence ends; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate
from math import lcm
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from skysurvey.llm.bpe import Merger, default_path
from skysurvey.llm.chunks import ChunkEncoder, LibraryLearner
from skysurvey.llm.common import prepare, trim, written

#: Tokens of a sequence, and the id that ends a document.
LENGTH = 2048
END = 1
#: Rows of (partition, source) sums that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Sources of a bucket of the shared queue, about.
BUCKET = 1000
#: Rows of an output batch.
BATCH = 50_000


class Phase(NamedTuple):
    """Running totals from token ``begin`` on: after queue i, (add[i] + y * rate[i]) // unit of the first y tokens."""

    begin: Fraction
    add: list[int]
    rate: list[int]
    unit: int


class Schedule:
    """How many tokens each queue has given after any number of sequences."""

    def __init__(self, sizes: list[int], weights: list[int], length: int):
        self.sizes, self.length = sizes, length
        self.total = sum(sizes)
        self.sequences = -(-self.total // length)
        self.phases = self._phases(weights)

    def _phases(self, weights: list[int]) -> list[Phase]:
        given = [Fraction(0)] * len(self.sizes)
        y = Fraction(0)
        phases = []
        while y < self.total:
            active = [i for i, n in enumerate(self.sizes) if given[i] < n]
            whole = sum(weights[i] for i in active)
            # At least a token for each sequence, so that rounding never takes one back.
            least = -(-whole // self.length)
            w = {i: max(weights[i], least) for i in active}
            whole = sum(w.values())
            step = min((self.sizes[i] - given[i]) * whole / w[i] for i in active)
            add, rate, a, r = [], [], Fraction(0), 0
            for i in range(len(self.sizes)):
                r += w.get(i, 0)
                a += given[i]
                rate.append(r)
                add.append(a - y * r / whole)
            unit = whole
            for x in add:
                unit = lcm(unit, x.denominator)
            phases.append(Phase(y, [int(x * unit) for x in add], [r * unit // whole for r in rate], unit))
            for i in active:
                given[i] += step * w[i] / whole
            y += step
        return phases

    def running(self, queue: int, sequence: int) -> int:
        """Tokens that queues 0..queue have given after the first ``sequence`` sequences."""
        if queue < 0:
            return 0
        y = min(sequence * self.length, self.total)
        phase = self.phases[0]
        for p in self.phases[1:]:
            if p.begin > y:
                break
            phase = p
        return (phase.add[queue] + y * phase.rate[queue]) // phase.unit

    def given(self, queue: int, sequence: int) -> int:
        return self.running(queue, sequence) - self.running(queue - 1, sequence)

    def sequence_of(self, queue: int, token: int) -> int:
        """The sequence that holds the queue's token."""
        low, high = 0, self.sequences - 1
        if len(self.phases) == 1:  # the deficit is less than one token
            guess = token * self.sequences // max(1, self.sizes[queue])
            width = 2 * self.sequences // max(1, self.sizes[queue]) + 2
            low, high = max(0, guess - width), min(high, guess + width)
            if self.given(queue, low) > token:
                low = 0
            if self.given(queue, high + 1) <= token:
                high = self.sequences - 1
        while low < high:
            mid = (low + high) // 2
            if self.given(queue, mid + 1) > token:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, queue: int, place: int, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document whose first token has that place in its queue."""
        if not tokens:
            return
        s, done = self.sequence_of(queue, place), 0
        below, upto = self.running(queue - 1, s), self.running(queue, s)
        while done < tokens:
            below_next, upto_next = self.running(queue - 1, s + 1), self.running(queue, s + 1)
            first, past = upto - below, upto_next - below_next
            n = min(past - place - done, tokens - done)
            if n > 0:
                yield done, n, s, (below_next - below) + (place + done - first)
                done += n
            s, below, upto = s + 1, below_next, upto_next


def tree_paths(sizes: list[int]) -> list[list[int]]:
    """Of each leaf of a balanced binary tree, from the leaf up: the child's size (negative for a second child) and its node's size, in turn."""
    ends = [0, *accumulate(sizes)]
    paths: list[list[int]] = [[] for _ in sizes]
    todo = [(0, len(sizes))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        whole = ends[high] - ends[low]
        mid = bisect_left(ends, ends[low] + whole // 2, low + 1, high - 1)
        for i in range(low, high):
            paths[i] += [whole, ends[mid] - ends[low] if i < mid else ends[mid] - ends[high]]
        todo += [(low, mid), (mid, high)]
    return [p[::-1] for p in paths]


def spread(path: list[int], place: int, tokens: int) -> np.ndarray:
    """Places in the shared queue of tokens that follow each other in their source."""
    at = np.arange(place, place + tokens)
    for child, whole in zip(path[::2], path[1::2]):
        if whole >= 1 << 31:  # products beyond 64 bits
            at = at.astype(object)
        at = ((at + 1) * whole + child - 1) // child - 1 if child > 0 else at * whole // -child
        at = at.astype(np.int64)
    return at


def with_paths(sources: DataFrame) -> DataFrame:
    """sources (source, n) as (source, path): the way through the tree of the shared queue."""
    buckets = -(-sources.count() // BUCKET)
    dealt = sources.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(max(1, buckets))))
    sums = sorted((r["bucket"], r["n"]) for r in dealt.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    above = dict(zip([b for b, _ in sums], tree_paths([n for _, n in sums])))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["n"].to_pylist(), table["source"].to_pylist()), reverse=True)
        paths = [p + above[key[0].as_py()] for p in tree_paths([n for n, _ in rows])]
        return pa.table({"source": pa.array([s for _, s in rows], pa.string()), "path": pa.array(paths, pa.list_(pa.int64()))})

    return dealt.groupBy("bucket").applyInArrow(run, "source string, path array<bigint>")


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(Merger(path), LibraryLearner(path))


def tokenized(docs: DataFrame, path: str, end: int, key: str, text: str, source: str) -> DataFrame:
    """Written rows (key, source, tokens, ids as little-endian 32-bit, part, before).

    ``before`` counts the tokens of the same source before this row in the same part.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            ids, sizes = encoder(path).encode(batch.column(2))
            before, blobs, at = [], [], 0
            for name, n in zip(batch.column(1).to_pylist(), sizes.tolist()):
                before.append(seen.get(name, 0))
                seen[name] = before[-1] + n + 1
                whole = np.append(ids[at : at + n], np.uint32(end))
                blobs.append((whole.astype("<u2") if whole.max() < 65536 else whole.astype("<u4")).tobytes())
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()), pa.array(blobs, pa.binary()), pa.array([part] * len(blobs), pa.int32()), pa.array(before, pa.int64())],
                ["key", "source", "tokens", "ids", "part", "before"],
            )
            del ids, blobs
            trim()

    prepare(docs.sparkSession)
    return written(slim.mapInArrow(run, f"key {kind}, source string, tokens bigint, ids binary, part int, before bigint"), "packing-tokens")


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, targets: dict[str, int] | None = None, vocabulary: str = "word_bpe_49k.json", path: str | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: integer weights of sources; sources it does not name share one queue of weight 1, by their sizes.
    """
    kind = docs.schema[key].dataType.simpleString()
    tokens = tokenized(docs, path or default_path(vocabulary), end, key, text, source)
    sums = tokens.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    if targets is None:
        own = [r["source"] for r in by_source.filter(F.col("n") * length >= total).select("source").collect()]  # no more than length
    else:
        own = list(targets)
    own = sorted(own)
    # Queue number: the place among the own queues; the others share the last one.
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(own) for x in (s, i))), F.col("source")), F.lit(len(own))) if own else F.lit(0)
    parts = sums.withColumn("queue", number.cast("int"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(parts.select("part", "source", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), "n"), "packing-places")
    found = {r["queue"]: r["n"] for r in base.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    sizes = [found.get(i, 0) for i in range(len(own) + 1)]
    weights = [max(1, n) for n in sizes] if targets is None else [*(targets[s] for s in own), 1]
    schedule = Schedule(sizes, weights, length)
    small = base.select("part", "source", "queue", "base")
    shared = base.filter(F.col("queue") == len(own)).groupBy("source").agg(F.sum("n").alias("n"))
    if sizes[-1]:
        small = small.join(written(with_paths(shared), "packing-paths"), "source", "left")
    else:
        small = small.withColumn("path", F.lit(None).cast("array<bigint>"))
    if base.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    joined = tokens.join(small, ["part", "source"]).select("key", "tokens", "ids", "queue", (F.col("base") + F.col("before")).alias("place"), "path")

    def pieces(queue: int, place: int, tokens: int, path: list[int] | None) -> Iterator[tuple[int, int, int, int]]:
        if not path:
            yield from schedule.pieces(queue, place, tokens)
            return
        at = spread(path, place, tokens)
        begins = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), tokens]
        for low, high in zip(begins, begins[1:]):
            for start, size, sequence, offset in schedule.pieces(queue, int(at[low]), high - low):
                yield low + start, size, sequence, offset

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        keys: list = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in columns)], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            keys.clear()
            return batch

        for batch in batches:
            key_type = batch.schema.field(0).type
            doc, n_tokens, blobs, queues, places, paths = (batch.column(i) for i in range(6))
            for d, n, blob, queue, place, path in zip(doc.to_pylist(), n_tokens.to_pylist(), blobs, queues.to_pylist(), places.to_pylist(), paths.to_pylist()):
                data = blob.as_buffer()
                ids = np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4").astype("<u4").tobytes()
                for start, size, sequence, offset in pieces(queue, place, n, path):
                    rows.append((start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset))
                    keys.append(d)
                    if len(rows) >= BATCH:
                        yield flush()
        if rows:
            yield flush()

    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return joined.mapInArrow(cut, schema).withColumnRenamed("key", key)
