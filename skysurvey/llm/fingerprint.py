"""Document fingerprints from closed syncmers, in DataFrame functions only.

Method: a text is the sequence of its white-space separated, lower-cased words, where
characters of scripts without spaces and those of words of more than 32 characters count
as a word each. Of every k-mer of four words the three inner 2-mers are hashed; the k-mer is an anchor (a
closed syncmer) if the smallest of them lies at an edge, the first or the last place.
That depends on the k-mer alone, so an edit changes only the anchors that overlap it.
The fingerprint holds the 64 anchors of the whole text whose hashes are smallest, each with
the place, counted in words, where it first stands (``sketch=None``: all anchors). Two
fingerprints are matched by position: of the 64 smallest hashes of their union the common
ones count, an estimate of the Jaccard similarity of the anchor sets, and of these, in the
order of their places in one text, the share that also goes on in the other one. So the
same words in another order are less alike than an edited text.

Documents are paired with the next one by descending key: ranges of keys with about
equal numbers of rows, taken from approximate quantiles, are sorted each in a partition
of its own, and the first row of each range is also put behind the last row of the range
before it. There are as many ranges as the text has ``RANGE_BYTES``, ``MOST_RANGES`` at most.
Texts are shuffled once; only the quantiles and each range's largest key reach the driver.

Defined results: a text of fewer than four words, or without an anchor, has the hash of
all its words as its only anchor; null text and text without words has the empty
fingerprint, and two empty fingerprints have likeness 1; rows with the same key follow
each other by a hash of their text; null keys come last; a single row is its own next;
an empty table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from skysurvey.llm.common import partitions

SKETCH = 64
#: Bytes of text of a range, about, and ranges at most, which bound what reaches the driver.
RANGE_BYTES = 32_000_000
MOST_RANGES = 65_536
#: Characters that are a word each: those of scripts written without spaces, and those of longer words than this.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsYi}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\p{IsJavanese}\p{IsBalinese}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}]"
LONGEST_WORD = 32


def _inner_hashes(words: Column) -> Column:
    """Hashes of the 2-mers of an array of word hashes."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _closed(inner: Column) -> Column:
    """By place: the hash of the k-mer there if it is a closed syncmer, null otherwise."""
    n = F.size(inner) - 2
    edges = F.zip_with(F.slice(inner, F.lit(1), n), F.slice(inner, F.lit(3), n), lambda a, c: F.struct(F.least(a, c).alias("least"), F.xxhash64(a, c).alias("hash")))
    picked = F.zip_with(edges, F.slice(inner, F.lit(2), n), lambda e, b: F.when(e["least"] <= b, e["hash"]))
    return F.when(n >= 1, picked).otherwise(F.array().cast("array<bigint>"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out: by word place, the anchor's hash or null; _words: the words' hashes."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), UNSPACED, " $0 "), r"\s+"), lambda w: w != "")
    words = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONGEST_WORD, F.split(w, "")).otherwise(F.array(w))))
    df = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_inner", _inner_hashes(F.col("_words")))
    return df.withColumn(out, _closed(F.col("_inner"))).drop("_inner")


_ANCHORS = "array<struct<hash: bigint, place: int>>"


def with_fingerprint(df: DataFrame, text: str, out: str, sketch: int | None = SKETCH) -> DataFrame:
    """df with the column out: (hash, first place) of the smallest anchor hashes of the text, by hash."""
    df = with_anchors(df, text, "_anchors")
    df = df.withColumn("_chosen", F.sort_array(F.array_distinct(F.array_compact("_anchors"))))
    # The anchors up to the last hash chosen, with their places; of equal ones the first stays.
    last = F.try_element_at(F.slice("_chosen", 1, sketch) if sketch else F.col("_chosen"), F.lit(-1))
    up_to = lambda t: F.transform("_anchors", lambda h, i: F.when(h <= t, F.struct(h.alias("hash"), i.alias("place"))))
    first = lambda rows: F.filter(rows, lambda s, i: (i == 0) | (s["hash"] != F.get(rows, i - 1)["hash"]))
    placed = _bound(F.sort_array(F.array_compact(_bound(last, up_to))), first)
    whole = F.when(F.size("_words") > 0, F.array(F.struct(F.xxhash64(F.col("_words")).alias("hash"), F.lit(0).alias("place")))).otherwise(F.array().cast(_ANCHORS))
    return df.withColumn(out, F.when(F.size("_chosen") > 0, placed).otherwise(whole)).drop("_words", "_anchors", "_chosen")


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, anchor) of every closed syncmer, for matching by position."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = with_anchors(slim, "text", "_anchors").select("key", F.posexplode("_anchors").alias("place", "anchor"))
    return placed.filter("anchor is not null").withColumnRenamed("key", key)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _likeness(a: str, b: str, sketch: int | None = SKETCH) -> Column:
    """The share of common hashes times the share of them that stand in one order."""
    one, two = F.col(f"{a}.hash"), F.col(f"{b}.hash")
    union = F.sort_array(F.array_union(one, two))
    union = F.slice(union, 1, sketch) if sketch else union

    def places(common: Column) -> Column:
        """Of the common anchors, in the order of the first text, the places in the second one."""
        # Both lists are in the order of hashes, so their common parts belong together entry by entry.
        own = lambda side: F.filter(side, lambda s: F.array_contains(common, s["hash"]))
        return F.transform(F.sort_array(F.zip_with(own(a), own(b), lambda s, t: F.struct(s["place"].alias("p"), t["place"].alias("q")))), lambda s: s["q"])

    def likeness(u: Column) -> Column:
        return _bound(_bound(F.array_intersect(F.array_intersect(one, two), u), places), lambda q: F.size(q) / F.greatest(F.size(u), F.lit(1)) * ordered(q))

    def ordered(q: Column) -> Column:
        n = F.size(q)
        later = F.filter(q, lambda x, i: (i > 0) & (x >= F.get(q, i - 1)))
        return F.when(n > 1, F.size(later) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(1.0))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_bound(union, likeness))


def _shown(fingerprint: str) -> Column:
    """Sixteen hexadecimal digits of the hash and eight of the place, anchor by anchor."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lpad(F.lower(F.hex(x["place"].cast("long"))), 8, "0"))), "")


def _longs(values: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_next(rows: DataFrame, carried: dict[str, str]) -> DataFrame:
    """rows (key, text, ...) with columns of the row that follows by descending key, the first after the last.

    carried: names of the new columns by the columns they are taken from.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(4 * partitions(spark), -(-size // RANGE_BYTES)), MOST_RANGES)
    cuts = rows.agg(F.approx_percentile("key", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    # A range's number: how many cuts lie below the key, counted by coarse steps and then by fine ones.
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = _longs(cuts[step - 1 :: step]), _longs(cuts)
    rows = rows.withColumn("_coarse", F.size(F.filter(coarse, lambda c: c < F.col("key"))) * step)
    rows = rows.withColumn("_range", F.when(F.col("key").isNull(), -1).otherwise(F.col("_coarse") + F.size(F.filter(F.slice(fine, F.col("_coarse") + 1, F.lit(step)), lambda c: c < F.col("key"))))).drop("_coarse")
    tops = {r["_range"]: r["top"] for r in rows.groupBy("_range").agg(F.max("key").alias("top")).collect()}  # at most MOST_RANGES + 1
    order = sorted(tops)
    rows = rows.withColumn("_after", F.lit(0))
    if order:
        # The first row of each range follows the last one of the range above it.
        # Arrays by range, from -1 (null keys) on.
        above = dict(zip(order, [*order[1:], order[0]]))
        every = range(-1, order[-1] + 1)
        top = F.get(_longs([tops.get(r) or 0 for r in every]), F.col("_range") + 1)
        target = F.get(_longs([above.get(r, r) for r in every]), F.col("_range") + 1).cast("int")
        first = F.coalesce(F.col("key") == top, F.lit(True))
        rows = rows.unionByName(rows.filter(first).withColumn("_range", target).withColumn("_after", F.lit(1)))
    window = Window.partitionBy("_range").orderBy("_after", F.desc_nulls_last("key"), "_order")
    rows = rows.withColumns({new: F.lead(old).over(window) for old, new in carried.items()})
    return rows.filter("_after = 0").drop("_range", "_after")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_fingerprint(rows.withColumn("_order", F.xxhash64("text")), "text", "own", sketch)
    rows = with_next(rows, {"text": "next_text", "own": "next"})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("_third", third)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("_third")), F.substring(F.col("next_text"), F.lit(1), F.col("_third")))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "changed", sketch)
    return rows.select(
        F.col("key").cast(kind).alias(key),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        _shown("own").alias("fingerprint"),
        _shown("changed").alias("edited_fingerprint"),
        _likeness("own", "changed", sketch).alias("near_edited"),
        _likeness("own", "next", sketch).alias("near_next"),
    )
