"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from skysurvey.llm import queries
from tests.compare import SF


def planted(spark):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "that", "with", "from", "which", "there"] + ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    clean = [text(rng.randint(60, 200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, clean[4] + " last"), (102, text(80) + " " + passage + " " + text(80)), (103, text(80) + " " + passage + " " + text(80)), (104, "12 34 56"), (105, None)]
    return spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), passage, len(clean)


def test_stages(spark):
    docs, passage, clean = planted(spark)
    names = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], SF).cache())
        assert tables[-1].columns == names and tables[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in t.collect()} for t in tables]
    assert ids[0] - ids[1] == {104, 105}
    assert ids[1] - ids[2] == {100, 101}
    left = {r.doc_id: r for r in tables[3].collect()}
    assert set(range(clean)) <= ids[3] and passage in left[102].text and passage not in left[103].text
    assert all(r.n_chars == len(r.text) for r in left.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[3], SF).collect()
    assert {r.doc_id for r in packed} == ids[3]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "suffix_array_dedup", "packing"]


def test_empty_table(spark):
    docs, _, _ = planted(spark)
    table = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert table.count() == 0


def test_one_query_for_each_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def brute_stages(rows):
    """(key, text) rows through the second and third stage, by plain loops."""
    from tests.llm.test_operators import jaccard_components

    component = {d: c for d, _, c, _ in jaccard_components(rows)}
    rows = [(d, t) for d, t in rows if component[d] == d]
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        left = bytes(x for x, g in zip(b, gone) if not g)
        if left:
            out[d] = left.decode("utf-8", "ignore")
    return out


def test_middle_stages_equal_plain_ones(spark):
    docs, _, _ = planted(spark)
    docs = docs.filter("text IS NOT NULL")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["suffix_array_dedup"](spark, stages["ngram_join"](spark, docs, SF), SF)
    assert {r.doc_id: r.text for r in out.collect()} == brute_stages([(r.doc_id, r.text) for r in docs.collect()])


def test_stages_of_odd_tables(spark):
    docs, _, clean = planted(spark)
    odd = docs.union(docs.filter("doc_id < 3")).union(docs.filter("doc_id = 5").selectExpr("cast(null as long)", "concat(text, ' more words at the end of this one')", "lang", "source", "n_chars"))
    odd = odd.selectExpr("*", "doc_id AS _doc", "text AS kept", "'x' AS Source2", "1 AS n_bytes")
    for frame in (odd, odd.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF).cache()
            assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        ids = [r.doc_id for r in kept.collect()]
        if frame is odd:
            assert set(range(clean)) <= set(ids) and len(ids) == len(set(ids))
            assert all(r._doc == r.doc_id and r.Source2 == "x" for r in kept.collect())
        assert {r.doc_id for r in packed.collect()} == set(ids)
