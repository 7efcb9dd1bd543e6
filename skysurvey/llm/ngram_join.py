"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row holds its distinct five-word shingles as 64-bit hashes. Two documents
link when ``100 * intersection >= 75 * union``.

Method:

1. The incidence matrix is cut into blocks: documents by scan batch, n-grams by hash
   bucket. Blocks travel as compact arrays. A bucket finds the columns with two or more
   documents; the others cannot add to any overlap and stop here. Only shared entries
   go on, with a class of the column's frequency, to the blocks of their documents.
2. A row that may differ from a partner's in at most ``e = n - ceil(0.75 n)`` entries
   needs all but e of its entries shared; rows with fewer are discarded (a bound from the
   size alone). Of the others the e + 1 entries in the rarest columns are kept: under
   one global order of columns, two linked rows must meet in one of these.
3. Rows with equal sets are one class, represented by the smallest document.
4. Rows that share a kept column are candidates. Rows with the same smallest partner lie
   in the same row blocks (of about ``BLOCK_ROWS`` rows and ``BLOCK_ENTRIES`` entries); blocks
   that share a kept column are multiplied: overlaps of all their rows are accumulated
   over slices of common columns, pairs below the bound of their sizes are discarded, and
   of the links a spanning forest goes on, and each row's number of links. So a group of
   near copies costs a few rows for each task, whatever the number of its links, and no link
   between rows is lost: two rows' blocks meet once, so numbers of links add up.
5. Components of the links are formed.

Large rows (over ``BIG_FROM`` entries) only use the half of the columns with a smaller
hash in steps 1 and 2, which meet the same bound; should a large row have too few
entries there, the join is done again with all columns.

Columns shared by more than ``hot`` documents of one batch are known to be shared there:
their entries pass by the bucket, which only gets one token of them.

Defined results: null text, and text without words, is an empty set and linked with
nothing; fewer than five words are one shingle; rows that repeat key and text share
one result; rows that repeat only a key are rows of their own, and their component is
named by its smallest key; null keys come last; an empty table gives an empty result.
A document's number of links counts the other documents it links with, copies one by one;
rows that repeat key and text are one document.
Only the key and the text are read. The key must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skysurvey.llm.common import discard, numbered, partitions, positional, prepare, slices, trim, written
from skysurvey.llm.components import connected_components

WORDS = 5
PERCENT = 75
#: Rows up to SMALL_TO use all columns, rows above BIG_FROM half of them; 100 * 192 = 75 * 256.
SMALL_TO, BIG_FROM = 256, 192
#: Documents of a batch that make a column hot.
HOT = 1000
BUCKET_BYTES = 16_000_000
GROUP = 1 << 19
#: Rows and entries of a row block, about, and columns of a slice of a product.
BLOCK_ROWS = 512
BLOCK_ENTRIES = 524_288
SLICE = 2048

_RNG = np.random.default_rng(20240608)
_BYTE = _RNG.integers(1, 2**63, 256).astype(np.uint64)
_ODD = _RNG.integers(1, 2**62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[15]) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_POWERS: dict[int, np.ndarray] = {}
_S = tuple(np.uint64(x) for x in (29, 32, 31, 33))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _ODD[k]
    x ^= x >> _S[0]
    x *= _ODD[k + 1]
    x ^= x >> _S[1]
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, GROUP + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of data, lower-cased; separators: by byte, whether it ends a word."""
    space = separators[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    terms = _LOWERED[data]
    terms *= _powers(_BASE, len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    found = (total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start]
    return _mix(found + (end - start).astype(np.uint64), 0), start, end


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    hashes, starts, _ = word_hashes(data)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cut = np.searchsorted(starts, bounds)
    whole = hashes[: max(len(hashes) - WORDS + 1, 0)].copy()
    for j in range(1, WORDS):
        whole = _mix(whole, 2 + j) + hashes[j : j + len(whole)]
    whole = _mix(whole, 8)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(whole[a : b - WORDS + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = _mix(short, 10) + h
            yield _mix(short, 11)
        else:
            yield hashes[:0]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP:
            yield from _sets(group)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _sets(group)


def allowed(n: np.ndarray | int) -> np.ndarray | int:
    """Entries of a row of size n that a linked row may lack."""
    return n - (-(-PERCENT * n // 100))


_ENTRY = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("small", "u1")])
_SHARED = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("small", "u1"), ("rank", "u1")])
_ROW = np.dtype([("doc", "<i8"), ("n", "<i8"), ("big", "<i8"), ("x", "<u8"), ("y", "<u8")])
_HALF = np.uint64(1 << 63)
_SMALL_SALT = np.uint64(0x5BF0_3635_1E2A_9D47)
#: Rank of a column that is hot in some batch.
_TOP = 255
_TOKEN = np.int64(-(2**63))


def _track(sets: list[np.ndarray], docs: np.ndarray, half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entries for steps 1 and 2, rows): small rows with all columns under a salted name, large ones with half of them.

    Rows of middling size are in both tracks, so that any two rows of sizes that can link share one.
    """
    rows = np.zeros(len(sets), _ROW)
    grams, owners, small = [], [], []
    for i, s in enumerate(sets):
        n = len(s)
        big = s[: np.searchsorted(s, _HALF)] if half else s
        rows[i] = (docs[i], n, len(big), np.add.reduce(_mix(s, 4)) if n else 0, np.add.reduce(_mix(s, 6)) if n else 0)
        if n > BIG_FROM:
            grams.append(big)
            owners.append(np.full(len(big), docs[i]))
            small.append(np.zeros(len(big), np.uint8))
        if 0 < n <= SMALL_TO:
            grams.append(s * _ODD[14] ^ _SMALL_SALT)
            owners.append(np.full(n, docs[i]))
            small.append(np.ones(n, np.uint8))
    entries = np.zeros(sum(map(len, grams)), _ENTRY)
    if grams:
        entries["gram"], entries["doc"], entries["small"] = np.concatenate(grams), np.concatenate(owners), np.concatenate(small)
    return entries, rows


def _starts(*keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _cut(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of each key as bytes."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    at = np.nonzero(_starts(keys))[0]
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
        yield int(keys[a]), rows[a:b].tobytes()


def matrix_blocks(texts: DataFrame, buckets: int, hot: int, half: bool) -> DataFrame:
    """Step 1: (bucket, kind, data): entries by bucket; rows and entries of hot columns under the task's own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = -1 - TaskContext.get().partitionId()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            entries, rows = _track(list(shingle_sets(batch.column(1).to_pylist())), docs, half)
            out = [(own, 0, rows.tobytes())]
            order = np.lexsort((entries["doc"], entries["gram"]))
            entries = entries[order]
            head = np.nonzero(_starts(entries["gram"]))[0] if len(entries) else np.zeros(0, int)
            count = np.diff(np.append(head, len(entries)))
            many = np.repeat(count > hot, count)
            if many.any():
                passed = np.zeros(many.sum(), _SHARED)
                passed["gram"], passed["doc"], passed["small"], passed["rank"] = entries["gram"][many], entries["doc"][many], entries["small"][many], _TOP
                out.append((own, 1, passed.tobytes()))
                tokens = entries[head[count > hot]].copy()
                tokens["doc"] = _TOKEN
                entries = np.concatenate([entries[~many], tokens])
            out += [(k, 2, b) for k, b in _cut((entries["gram"] % np.uint64(buckets)).astype(np.int64), entries)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "data"])
            del out, entries, rows
            trim()

    return texts.mapInArrow(run, "bucket bigint, kind int, data binary")


def shared_columns(blocks: DataFrame, groups: int) -> DataFrame:
    """Step 1: (group, kind, data): shared entries and rows, by group of documents."""

    def bucket(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        kinds = table.column("kind").to_pylist()
        blobs = [x.as_buffer() for x in table.column("data")]
        for kind, shape in ((0, _ROW), (1, _SHARED)):
            found = [np.frombuffer(b, shape) for b, k in zip(blobs, kinds) if k == kind]
            if found:
                rows = np.concatenate(found)
                out += [(k, kind, b) for k, b in _cut(rows["doc"] % groups, rows)]
        found = [np.frombuffer(b, _ENTRY) for b, k in zip(blobs, kinds) if k == 2]
        if found:
            entries = np.concatenate(found)
            entries = entries[np.lexsort((entries["doc"], entries["gram"]))]
            entries = entries[_starts(entries["gram"], entries["doc"])]
            head = np.nonzero(_starts(entries["gram"]))[0]
            count = np.diff(np.append(head, len(entries)))
            rank = np.minimum(1 + np.log2(count) * 8, _TOP - 1).astype(np.uint8)
            rank[entries["doc"][head] == _TOKEN] = _TOP
            rank = np.repeat(rank, count)
            keep = (np.repeat(count > 1, count) | (rank == _TOP)) & (entries["doc"] != _TOKEN)
            shared = np.zeros(keep.sum(), _SHARED)
            shared["gram"], shared["doc"], shared["small"], shared["rank"] = entries["gram"][keep], entries["doc"][keep], entries["small"][keep], rank[keep]
            del entries
            if len(shared):
                out += [(k, 1, b) for k, b in _cut(shared["doc"] % groups, shared)]
            del shared
        del found, blobs
        trim()
        return pa.table({"group": pa.array([o[0] for o in out], pa.int64()), "kind": pa.array([o[1] for o in out], pa.int32()), "data": pa.array([o[2] for o in out], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(bucket, "group bigint, kind int, data binary")


def bounded_rows(shared: DataFrame) -> DataFrame:
    """Step 2: (doc, n, x, y, short, grams): each row's size, set names and kept columns (null: discarded)."""

    def group(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = [x.as_buffer() for x in table.column("data")]
        rows = np.concatenate([np.frombuffer(b, _ROW) for b, k in zip(blobs, kinds) if k == 0])
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        rows = rows[_starts(rows["doc"])]
        found = [np.frombuffer(b, _SHARED) for b, k in zip(blobs, kinds) if k == 1]
        entries = np.concatenate(found) if found else np.zeros(0, _SHARED)
        del found, blobs
        entries = entries[np.lexsort((entries["gram"], entries["rank"], entries["small"], entries["doc"]))]
        place = entries["doc"]
        small = entries["small"] == 1
        kept: list[np.ndarray | None] = []
        short = []
        for i, (a, b) in enumerate(zip(np.searchsorted(place, rows["doc"]).tolist(), np.searchsorted(place, rows["doc"], "right").tolist())):
            n, big = int(rows["n"][i]), int(rows["big"][i])
            spare = allowed(n)
            short.append(n > BIG_FROM and big <= spare)
            mid = a + int(np.searchsorted(small[a:b], True))
            parts = []
            for low, high, total in ((a, mid, big if n > BIG_FROM else 0), (mid, b, n if n <= SMALL_TO else 0)):
                alone = total - (high - low)  # entries in columns of their own come first
                if high > low and alone <= spare:
                    parts.append(entries["gram"][low : min(high, low + spare + 1 - alone)])
            kept.append(np.concatenate(parts).astype(np.int64) if parts else None)
        del entries, place, small
        trim()
        return pa.table({
            "doc": pa.array(rows["doc"]), "n": pa.array(rows["n"]), "x": pa.array(rows["x"].view(np.int64)), "y": pa.array(rows["y"].view(np.int64)),
            "short": pa.array(short, pa.bool_()), "grams": pa.array(kept, pa.list_(pa.int64())),
        })

    return shared.groupBy("group").applyInArrow(group, "doc bigint, n bigint, x bigint, y bigint, short boolean, grams array<bigint>")


def _slices(sets: list[np.ndarray], common: np.ndarray) -> Iterator[np.ndarray]:
    """Dense incidence matrices of rows by slices of columns."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(common, flat)
    hit = common[np.minimum(at, len(common) - 1)] == flat
    rows, at = rows[hit], at[hit]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for low in range(0, len(common), SLICE):
        a, b = np.searchsorted(at, [low, low + SLICE])
        part = np.zeros((len(sets), min(SLICE, len(common) - low)), np.float32)
        part[rows[a:b], at[a:b] - low] = 1
        yield part


def product_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Whether rows of two blocks (or of one block among themselves) link: the blocks' product against the bound."""
    other = left if right is None else right
    if right is None:
        columns, counts = np.unique(np.concatenate(left), return_counts=True)
        common = columns[counts > 1]
    else:
        common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(other)), np.float64)
    if len(common):
        if right is None:
            for part in _slices(left, common):
                total += part @ part.T
        else:
            for part, match in zip(_slices(left, common), _slices(right, common)):
                total += part @ match.T
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    return (total > 0) & (100 * total >= PERCENT * (n[:, None] + m[None, :] - total))


def spanning_edges(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    edges: list[tuple[int, int]] = []
    todo = links.copy()
    for start in np.nonzero(links.any(axis=1))[0].tolist():
        if not todo[start].any():
            continue
        front = [start]
        while front:
            i = front.pop()
            for j in np.nonzero(todo[i])[0].tolist():
                edges.append((int(rows[i]), int(columns[j])))
                more = np.nonzero(todo[:, j])[0]
                todo[:, j] = False
                front += [k for k in more.tolist() if k != i]
                edges += [(int(rows[k]), int(columns[j])) for k in more.tolist() if k != i]
    return [e for e in edges if e[0] != e[1]]


class _Block:
    """A row block: its number, its documents, how many copies each stands for, and their rows."""

    def __init__(self, number: pa.Scalar, items: pa.ListScalar):
        values = items.values
        self.number = number.as_py()
        self.docs, self.copies = values.field("doc").to_numpy(), values.field("copies").to_numpy()
        self.rows = [np.frombuffer(g.as_buffer(), "<u8") for g in values.field("grams")]


def block_links(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links within blocks and between the given pairs (p, q) of blocks: (a, b) that span them, and (block, docs, links) with numbers of links as packed arrays."""

    def forest(found: Iterator[tuple[np.ndarray, _Block, _Block]]) -> Iterator[pa.RecordBatch]:
        """A task's links as edges to the smallest row of what they connect, no more than the task has rows, and a row of numbers for each block."""
        parent: dict[int, int] = {}
        docs: dict[int, np.ndarray] = {}
        degrees: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def count(block: _Block, links: np.ndarray) -> None:
            if links.any():
                docs[block.number] = block.docs
                degrees[block.number] = degrees.get(block.number, 0) + links

        for links, one, two in found:
            if one is two:
                np.fill_diagonal(links, False)
            else:
                count(two, one.copies @ links)
            count(one, links @ two.copies)
            for u, v in spanning_edges(links, one.docs, two.docs):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            trim()
        edges = [(x, root(x)) for x in parent]
        edges = [e for e in edges if e[0] != e[1]]
        none, packed = [None] * len(edges), list(docs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e[0] for e in edges] + [None] * len(packed), pa.int64()), pa.array([e[1] for e in edges] + [None] * len(packed), pa.int64()), pa.array(none + packed, pa.int64()),
                pa.array(none + [docs[k].astype("<i8").tobytes() for k in packed], pa.binary()), pa.array(none + [degrees[k].astype("<i8").tobytes() for k in packed], pa.binary()),
            ], ["a", "b", "block", "docs", "links"],
        )

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for number, items in zip(batch.column(0), batch.column(1)):
                    block = _Block(number, items)
                    yield product_links(block.rows, None), block, block

        yield from forest(found())

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for p, u, q, v in zip(*(batch.column(k) for k in range(4))):
                    one, two = _Block(p, u), _Block(q, v)
                    yield product_links(one.rows, two.rows), one, two

        yield from forest(found())

    own = blocks.filter(F.size("items") > 1).select("block", "items").mapInArrow(inside, _LINKS)
    left, right = blocks.select(F.col("block").alias("p"), F.col("items").alias("u")), blocks.select(F.col("block").alias("q"), F.col("items").alias("v"))
    return own.union(pairs.join(left, "p").join(right, "q").select("p", "u", "q", "v").mapInArrow(between, _LINKS))


_LINKS = "a bigint, b bigint, block bigint, docs binary, links binary"


def link_numbers(links: DataFrame) -> DataFrame:
    """(rep, links): every row's number of links, from the blocks' packed arrays."""

    def block(table: pa.Table) -> pa.Table:
        docs = np.frombuffer(table.column("docs")[0].as_buffer(), "<i8")
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table.column("links"))
        return pa.table({"rep": pa.array(docs), "links": pa.array(total)})

    return links.filter("block IS NOT NULL").groupBy("block").applyInArrow(block, "rep bigint, links bigint")


def similar_classes(texts: DataFrame, hot: int = HOT, half: bool = True) -> DataFrame:
    """(doc, n, component, links) of rows (doc, text as bytes); doc is unique up to repeated rows."""
    spark = texts.sparkSession
    prepare(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(spark), -(-size // BUCKET_BYTES))
    rows = written(bounded_rows(shared_columns(matrix_blocks(texts, buckets, hot, half), max(8, buckets // 8))), "ngram-rows")
    if half and not rows.filter("short").isEmpty():
        return similar_classes(texts, hot, False)
    classes = rows.filter("n > 0").groupBy("n", "x", "y").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    kept = rows.filter("grams is not null").select("doc", "n", "grams").join(classes.select(F.col("rep").alias("doc"), "copies"), "doc")
    members = kept.select("doc", "n", "copies", F.explode("grams").alias("gram"))
    columns = members.groupBy("gram").agg(F.min("doc").alias("lead"), F.count("*").alias("k")).filter("k > 1").select("gram", "lead")
    members = written(members.join(columns, "gram"), "ngram-members")
    # Row blocks: rows with the same smallest partner, dealt out by hash where there are many.
    home = members.groupBy("doc", "n", "copies").agg(F.min("lead").alias("lead"))
    parts = home.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_ENTRIES)).alias("parts"))
    home = written(home.join(parts, "lead").select("doc", "copies", F.xxhash64("lead", F.pmod(F.xxhash64("doc"), "parts")).alias("block")), "ngram-homes")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array([s.tobytes() for s in shingle_sets(part.column(3).to_pylist())], pa.binary())], ["block", "doc", "copies", "grams"])
                trim()

    # The same plan at every size: the number of rows that take part grows with the data.
    rowsets = texts.join(home.hint("merge"), "doc").select("block", "doc", "copies", "text").mapInArrow(whole, "block bigint, doc bigint, copies bigint, grams binary")
    blocks = written(rowsets.groupBy("block").agg(F.collect_set(F.struct("doc", "copies", "grams")).alias("items")), "ngram-blocks")
    # Blocks that share a column; columns with the same blocks give the same pairs, one of them is enough.
    met = members.select("doc", "gram").join(home, "doc").select("gram", "block").distinct()
    several = met.groupBy("gram").agg(F.count("*").alias("k"), F.sum(F.xxhash64("block").cast("decimal(38,0)")).alias("sign")).filter("k > 1").groupBy("k", "sign").agg(F.min("gram").alias("gram")).select("gram")
    met = written(met.join(several, "gram"), "ngram-met")
    pairs = met.select("gram", F.col("block").alias("p")).join(met.select("gram", F.col("block").alias("q")), "gram").filter("p < q").select("p", "q").distinct()
    links = written(block_links(pairs, blocks), "ngram-links")
    for table in (members, home, blocks, met):
        discard(table)
    components = connected_components(links.filter("a IS NOT NULL").select("a", "b"))
    named = classes.join(components, classes["rep"] == components["node"], "left").join(link_numbers(links), "rep", "left")
    named = named.select("n", "x", "y", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return rows.select("doc", "n", "x", "y").join(named, ["n", "x", "y"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def ngram_join(docs: DataFrame, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, n_links."""
    base, same = numbered(docs.select(key, text).toDF("key", "text"), "key", "text")
    texts = base.select(F.col("_doc").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = similar_classes(texts, hot).withColumnsRenamed({"n": "n_shingles", "links": "n_links"})
    kind = docs.schema[key].dataType
    if same:
        return found.select(F.col("doc").cast(kind).alias(key), "n_shingles", F.col("component").cast(kind).alias("component_id"), "n_links")
    keys = base.select(F.col("_doc").alias("component"), F.col("key").alias("component_id")).distinct()
    rows = base.select("key", F.col("_doc").alias("doc")).join(found.distinct(), "doc").join(keys, "component")
    return rows.select(F.col("key").alias(key), "n_shingles", "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest key."""
    flat, (c_key, c_text) = positional(docs, key, text)
    base, same = numbered(flat, c_key, c_text)
    texts = base.select(F.col("_doc").alias("doc"), F.coalesce(F.col(c_text).cast("string"), F.lit("")).cast("binary").alias("text"))
    firsts = similar_classes(texts, hot).filter("doc = component").select(F.col("doc").alias("_doc"))
    kept = base.join(firsts, "_doc", "left_semi")
    return (kept if same else kept.dropDuplicates(["_doc"])).select(*flat.columns).toDF(*docs.columns)
