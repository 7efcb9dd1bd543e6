"""The operators against brute force, round trips and the libraries, with their edge cases."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skysurvey.llm import html_extract as H, html_train as HT, license_scan as L, media as M, ngram_join as ngram_module, suffix_dedup as suffix_module
from skysurvey.llm.bpe import BYTE_LEVEL_PATTERN, SAFE_LAST, WORD_PATTERN, Merger, default_path
from skysurvey.llm.bpe_codec import TrieEncoder, encode_decode
from skysurvey.llm.chunks import ChunkEncoder, LibraryLearner
from skysurvey.llm.components import connected_components
from skysurvey.llm.fingerprint import anchors, fingerprints
from skysurvey.llm.langid import BUCKETS, LONGEST, bucket_counts, fit as fit_language, hashed_grams, keep_identified, language_id
from skysurvey.llm.ngram_join import keep_one_of_each, ngram_join
from skysurvey.llm.packing import Schedule, pack_documents, spread, tree_paths
from skysurvey.llm.suffix_dedup import suffix_dedup, without_repeats
from skysurvey.llm.token_count import token_counts
from tests.compare import SF

ODD = [
    None, "", " ", "a  b", "a \n  b", "\n\n x", "foo\n bar", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>z  ", "日本語 テスト", "Σας ΑΣ", "İstanbul", "ﬁ é É",
    "a\x1cb\x85c\xa0d", "don't 'S 'LL I'Ll", "x" * 3000, "ab" * 2000 + "é" * 300, "🎉🎉 ​ zero", " leading", "trailing ", "tab\tx\t\ty", "\r\n\r\n a", "١٢٣ ٤",
    "<|startoftext|>a<|end", "𝔘𝔫𝔦 ½ ²", "नमस्ते दुनिया", "à́b  ", "ǅ ŉ ß ẞ", "nul\0l \0", "word. word, w.o.r.d ...", "same text", "same text",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "x", "src", i, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


OPERATORS = {
    "token_counts": token_counts, "license_scan": L.license_scan, "ngram_join": ngram_join, "fingerprints": fingerprints, "pack_documents": pack_documents,
    "suffix_dedup": suffix_dedup, "encode_decode": encode_decode, "media_columns": M.media_columns, "language_id": language_id,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_and_repeated_keys(spark, name):
    rows = [(None, "some words in a row here", None, None), (None, None, None, None), (3, "same words twice over here", "en", "a"), (3, "same words twice over here", "en", "a"), (3, "other words", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = OPERATORS[name](df)
    if name == "license_scan":
        assert got.count() == 0
    elif name == "pack_documents":
        assert got.agg(F.sum("length")).first()[0] == got.dropDuplicates(["sequence_id", "offset"]).agg(F.sum("length")).first()[0]
    else:
        assert got.count() == len(rows)


# ---- 1, 8: tokens ----------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_token_counts_match_library(request, table):
    df = request.getfixturevalue(table)
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    texts = texts_of(df)
    for r in token_counts(df).collect():
        want = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 512)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_codec_matches_library(request, table):
    df = request.getfixturevalue(table)
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    texts = texts_of(df)
    for r in encode_decode(df, full=True).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_character_classes_agree_with_the_library():
    import unicodedata

    import regex

    one, two = Tokenizer.from_file(default_path("byte_bpe_50k.json")), Tokenizer.from_file(default_path("word_bpe_49k.json"))
    first, second = regex.compile(BYTE_LEVEL_PATTERN), regex.compile(WORD_PATTERN)
    for cp in range(SAFE_LAST + 1):
        ch = chr(cp)
        text = f"a{ch}B 1{ch}{ch} .{ch}.{ch} a  {ch}  b"
        assert first.findall(text) == [text[a:b] for _, (a, b) in one.pre_tokenizer.pre_tokenize_str(text)]
        normal = two.normalizer.normalize_str(text)
        assert normal == regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()
        assert second.findall(normal) == [normal[a:b] for _, (a, b) in two.pre_tokenizer.pre_tokenize_str(normal)]


def test_trie_states_equal_plain_merging():
    merger = Merger(default_path("word_bpe_49k.json"))
    rng = random.Random(1)
    words = {"".join(rng.choice("thaeinorsdl") for _ in range(rng.randint(1, 14))) for _ in range(500)}
    for word, ids in TrieEncoder(merger).encode(words).items():
        assert [merger.ids[t] for t in merger.merge(merger.symbols(word))] == list(ids)


# ---- 2: pages --------------------------------------------------------------


def test_pages_give_their_article(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", article)]
        assert found[r.page_id].text == "\n".join(x for x in parts if x) and found[r.page_id].n_chars == len(found[r.page_id].text)


def test_labels_of_generated_pages():
    right = total = 0
    for seed in range(500_000, 500_200):
        page, labels = HT.example(seed)
        if len(labels):
            score = H.scores(H.trained(), [H.inputs(H.trained(), page)])[0]
            right += ((score >= 0.5) == (labels == 1)).sum()
            total += len(labels)
    assert right / total > 0.98


def test_batched_scores_equal_single_ones():
    pages = [H.encode(H.blocks(HT.Maker(s).page().replace(HT.ARTICLE, "").replace(HT.OTHER, ""))) for s in range(12)]
    pages = [H.inputs(H.trained(), p) for p in pages if len(p.measures)]
    for one, many in zip(pages, H.scores(H.trained(), pages)):
        assert np.allclose(H.scores(H.trained(), [one])[0], many, atol=1e-5)


def test_broken_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<!-- never closed"), (4, "u", "<article><p>Some text &amp; more<script>var x='<p>no</p>'"), (4, "u", "<p")]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = [r.text for r in got.orderBy("page_id", F.desc("n_chars")).collect()]
    assert texts == ["", "", "", "Some text & more", ""]
    assert H.extract_pages(got.sparkSession.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("markup", "want"), [
    ('<svg-icon name="a"></svg-icon>', ["one", "two"]), ("<select-menu></select-menu>", ["one", "two"]), ('<svg width="1"/>', ["one", "two"]), ("<math/>", ["one", "two"]),
    ("<svg><path d='M0'>", ["one", "two"]), ("<svg><text>a</text><text>label</text></svg>", ["one", "a", "label", "two"]), ("<select><option>no</select>", ["one", "two"]), ("<template><p>no</template>", ["one", "two"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data='a'>a chart</object></p>", ["one", "so x=2 and a chart", "two"]),
    ("<p>an <svg/>icon <svg><title>no</title><g><path/></g></svg>here</p>", ["one", "an icon here", "two"]), ("<script>no<p>no</p>", ["one"]), ("<style-guide>yes</style-guide>", ["one", "yes", "two"]),
])
def test_markup_does_not_end_the_page(markup, want):
    assert [b.text for b in H.blocks(f"<p>one</p>{markup}<p>two</p>")] == want


def test_many_unclosed_elements_take_linear_time():
    assert len(H.blocks("<svg><p>a</p>" * 20_000)) == 20_000


# ---- 3: licenses -----------------------------------------------------------


def test_license_lines_and_texts(documents):
    lines = {"apache-2.0-line": "Licensed under the Apache License, Version 2.0", "mit-line": "Released under the MIT License", "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3", "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0"}
    texts = texts_of(documents)
    want = {(d, n, t.index(s), t.index(s) + len(s)) for d, t in texts.items() for n, s in lines.items() if s in t}
    assert {(r.doc_id, r.license, r.span_start, r.span_end) for r in L.license_scan(documents).collect()} == want


def test_license_alignment(spark):
    mit = L.TEMPLATES["mit"]
    changed = "é " * 30 + mit.replace("granted", "given").replace("Software is furnished", "thing is furnished") + " other words " * 20 + L.TEMPLATES["isc"]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    rows = L.license_scan(spark.createDataFrame([(1, changed), (2, half), (3, mit + "\n" + mit)], "doc_id int, text string")).orderBy("doc_id", "span_start").collect()
    assert [(r.doc_id, r.license) for r in rows] == [(1, "mit"), (1, "isc"), (3, "mit"), (3, "mit")]
    assert 0.95 < rows[0].coverage < 1 and rows[0].span_start == 60 and rows[1].coverage == 1


@pytest.mark.parametrize(("text", "want"), [("Released under the MIT License. " * 3, 3), ("Licensed under CC BY-NC 4.0." * 2, 2), ("Licensed under CC BY-NC 4.0. Released under the MIT License. " * 4, 8)])
def test_adjacent_notices(spark, text, want):
    rows = L.license_scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("span_start").collect()
    assert len(rows) == want and all(r.coverage == 1 for r in rows) and all(a.span_end <= b.span_start for a, b in zip(rows, rows[1:]))


def test_scan_equals_a_search_of_every_place():
    rng = random.Random(6)
    templates = {"a": "one two three four five six", "b": "seven eight nine ten eleven twelve one two", "c": " ".join(f"t{i}" for i in range(40))}
    scanner = L.Scanner(templates, 0.8)
    for _ in range(300):
        words, want = [], []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.6:
                name = rng.choice("abc")
                want.append((name, len(words), len(words) + len(templates[name].split())))
                words += templates[name].split()
            else:
                words += [f"x{rng.randint(0, 50)}" for _ in range(rng.randint(1, 5))]
        plain = [(n, i, i + len(t.split())) for n, t in templates.items() for i in range(len(words)) if words[i : i + len(t.split())] == t.split()]
        found = scanner.scan_all([" ".join(words).encode()])[0]
        starts = {len(" ".join(words[:i])) + (i > 0): i for i in range(len(words) + 1)}
        assert sorted((n, starts[a]) for n, c, a, b, m in found if c == 1) == sorted((n, a) for n, a, _ in plain) == sorted((n, a) for n, a, _ in want)


# ---- 4: Jaccard join -------------------------------------------------------

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = _WORDS.findall((text or "").translate(_LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}
    links = collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = collections.defaultdict(list)
    for i, (d, s) in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in owners[g]).items():
            if 100 * k >= 75 * (len(s) + len(sets[j][1]) - k):
                links.update((d, sets[j][0]))
                a, b = root(d), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            owners[g].append(i)
    return sorted((d, len(s), root(d), links[d]) for d, s in sets)


def near_copies(seed, groups=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "B"]
    rows = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "\t\n")]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 180, 230, 260, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            rows.append((len(rows) * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_numbers_of_links_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_module, "BLOCK_ROWS", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: rng.randint(40, 60)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join(df).collect())) == jaccard_components(rows)


def test_large_rows_with_all_columns(spark):
    rows = near_copies(4, 12)
    df = spark.createDataFrame(rows, "doc long, text string").select("doc", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    one, two = (sorted(map(tuple, ngram_module.similar_classes(df, half=half).collect())) for half in (True, False))
    assert one == two == jaccard_components(rows)


@pytest.mark.parametrize("hot", [1000, 2])
def test_jaccard_join(spark, hot):
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join(df, hot=hot).collect())) == jaccard_components(rows)


def test_jaccard_join_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = jaccard_components(rows)
    assert sorted(map(tuple, ngram_join(documents).collect())) == want
    assert sorted(r.doc_id for r in keep_one_of_each(documents).collect()) == sorted({c for _, _, c, _ in want})


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert all(r.component == root(r.node) for r in got)
    assert {r.node for r in got} == {x for a, b in edges if a != b for x in (a, b)} and len(got) == len({r.node for r in got})


# ---- 5: fingerprints -------------------------------------------------------


def test_fingerprint_edits(documents):
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    following = {d: rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows)}
    texts = dict(rows)
    found = fingerprints(documents).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        t, third = texts[r.doc_id], len(texts[r.doc_id]) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - third] + following[r.doc_id][:third]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    long = [r for r in found if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.95


@pytest.mark.parametrize("alphabet", ["日本語文章検索結果東京都市山川海空", "あいうえおカキクケコさしすせそ", "กขคงจฉชซญดตถทนบปพม", "abcdefghijklmnopqrstuvwxyz0123456789", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉"])
def test_texts_without_spaces_have_anchors(spark, alphabet):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(alphabet, k=600))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.near_edited > 0.25 > r.near_next for r in fingerprints(df).collect())
    assert anchors(df).groupBy("doc_id").count().filter("count > 100").count() == 6


def plain_fingerprint(spark, text):
    """Anchors by plain loops over the words' hashes, which come from Spark."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.xxhash64("w").alias("h"))
    hashes = [r.h for r in frame.orderBy("i").collect()]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(hashes, hashes[1:]))], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("h"))
    inner = [r.h for r in pairs.orderBy("i").collect()]
    edges = spark.createDataFrame([(i, inner[i], inner[i + 2]) for i in range(len(inner) - 2) if min(inner[i : i + 3]) != inner[i + 1] or inner[i + 1] in (inner[i], inner[i + 2])], "i int, a long, c long")
    found = {}
    for r in edges.select("i", F.xxhash64("a", "c").alias("h")).orderBy("i").collect():
        found.setdefault(r.h, r.i)
    return dict(sorted(found.items())[:64])


def plain_likeness(one, two):
    union = sorted(set(one) | set(two))[:64]
    common = sorted((one[h], two[h]) for h in union if h in one and h in two)
    steps = [b[1] >= a[1] for a, b in zip(common, common[1:])]
    return len(common) / len(union) * (sum(steps) / len(steps) if steps else 1.0)


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(120)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(8, 300))) for i in range(8)}
    texts[8] = " ".join(reversed([texts[7][i : i + 40] for i in range(0, len(texts[7]), 40)]))
    plain = {k: plain_fingerprint(spark, t) for k, t in texts.items()}
    rows = {r.doc_id: r for r in fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, r in rows.items():
        shown = "".join(f"{h % 2**64:016x}{p:08x}" for h, p in plain[k].items())
        assert r.fingerprint == shown and abs(r.near_next - plain_likeness(plain[k], plain[(k - 1) % 9])) < 1e-12
    assert rows[8].near_next < 0.75  # the same passages in another order


def test_fingerprints_without_a_sketch_hold_all_anchors(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], "doc_id long, text string")
    row, places = fingerprints(df, sketch=None).first(), anchors(df)
    assert len(row.fingerprint) == 24 * places.select("anchor").distinct().count() > 24 * 64 and row.near_next == 1.0


def test_fingerprint_edge_cases(spark, odd):
    assert fingerprints(odd).count() == len(ODD)
    one = fingerprints(spark.createDataFrame([(5, "a b c d e f")], "doc_id int, text string")).first()
    assert one.near_next == 1.0
    two = fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).collect()
    assert all(r.fingerprint == "" and r.near_next == 1.0 for r in two)


def test_anchors_are_context_free(spark):
    words = [f"w{i * 37 % 101}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", "y", *words]))], "doc_id int, text string")
    rows = anchors(df).collect()
    first = {(r.place, r.anchor) for r in rows if r.doc_id == 1}
    second = {(r.place - 2, r.anchor) for r in rows if r.doc_id == 2}
    assert first <= second and len(first) > 10


# ---- 6: packing ------------------------------------------------------------


def check_packing(pieces, length, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for d, parts in by_doc.items():
        assert sum(p.length for p in parts) == len(ids[d])
    for k, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or k == max(by_sequence) and at < length
    assert set(by_doc) == set(ids)


@pytest.mark.parametrize("targets", [None, {"src0": 3, "src1": 1}])
def test_packing(documents, targets):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in texts_of(documents).items()}
    check_packing(pack_documents(documents, targets=targets).collect(), 2048, ids)


def test_packing_odd_texts(odd):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in texts_of(odd).items()}
    check_packing(pack_documents(odd, length=64).collect(), 64, ids)


def test_mixture_is_kept(spark):
    rows = [(i, "word " * (5 + i % 40), "abc"[i % 10 // 4]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = pack_documents(df, length=100).join(df.select("doc_id", "source"), "doc_id")
    total = got.groupBy("source").agg(F.sum("length").alias("n"))
    share = {r.source: r.n for r in total.collect()}
    whole = sum(share.values())
    last = got.agg(F.max("sequence_id")).first()[0]
    for r in got.filter(F.col("sequence_id") < last).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect():
        assert abs(r.n - 100 * share[r.source] / whole) < 2


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1}])
def test_mixture_of_more_sources_than_tokens(spark, targets):
    rows = [(i, "word " * (5 + i % 40), f"s{i % 100}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = pack_documents(df, length=32, targets=targets)
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    check_packing(found.collect(), 32, {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in texts_of(df).items()})
    got = collections.defaultdict(collections.Counter)
    for r in found.join(df.select("doc_id", "source"), "doc_id").collect():
        if r.source not in (targets or {}):
            got[r.sequence_id][r.source] += r.length
    share = sum(got.values(), collections.Counter())
    whole, seen = sum(share.values()), collections.Counter()
    for k in range(max(got) + 1):
        seen += got[k]
        for s in share:
            assert abs(seen[s] - sum(seen.values()) * share[s] / whole) < 4


@pytest.mark.parametrize("seed", range(20))
def test_tree_deals_every_place_once(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, rng.randint(1, 300)]) for _ in range(rng.randint(1, 60))]
    places = [spread(p, 0, n).tolist() for p, n in zip(tree_paths(sizes), sizes)]
    assert all(p == sorted(p) for p in places) and sorted(sum(places, [])) == list(range(sum(sizes)))
    assert spread([1 << 40, 1 << 41], 1 << 39, 2).tolist() == [(1 << 40) + 1, (1 << 40) + 3]
    assert spread([-(1 << 40), 1 << 41], 1 << 39, 2).tolist() == [1 << 40, (1 << 40) + 2]


@pytest.mark.parametrize("seed", range(60))
def test_schedule(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 16, 64])
    sizes = [rng.choice([0, 1, 5, rng.randint(0, 500)]) for _ in range(rng.randint(1, 6))]
    if not sum(sizes):
        sizes[0] = 3
    for weights in ([max(1, x) for x in sizes], [rng.randint(1, 9) for _ in sizes]):
        schedule = Schedule(sizes, weights, length)
        filled = set()
        for q, n in enumerate(sizes):
            place = 0
            while place < n:
                m = min(n - place, rng.randint(1, 40))
                done = 0
                for start, size, sequence, offset in schedule.pieces(q, place, m):
                    assert start == done and size > 0
                    done += size
                    for k in range(size):
                        assert (sequence, offset + k) not in filled
                        filled.add((sequence, offset + k))
                assert done == m
                place += m
        assert filled == {(t // length, t % length) for t in range(sum(sizes))}


def test_chunk_encoder_matches_library():
    path = default_path("word_bpe_49k.json")
    import pyarrow as pa

    library = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD]
    ids, sizes = ChunkEncoder(Merger(path), LibraryLearner(path)).encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids
        at += n


# ---- 7: repeated strings ---------------------------------------------------


def removed(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repetitive(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    bases = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(50):
        t = ""
        for _ in range(rng.randint(0, 5)):
            k, b = rng.random(), rng.choice(bases)
            if k < 0.5:
                a = rng.randint(0, len(b) - 1)
                t += b[a : a + rng.randint(1, 300)]
            elif k < 0.6:
                t += "a" * rng.randint(1, 300)
            elif k < 0.7:
                t += "abc" * rng.randint(1, 150)
            else:
                t += " ".join(word() for _ in range(rng.randint(1, 60)))
        rows.append((i * 3, t))
    return [*rows, (500, None), (501, "x y " * 18000), (502, "ab" * 40000 + bases[0] * 30)]


@pytest.mark.parametrize("size", [None, 300])
def test_repeated_strings(spark, monkeypatch, size):
    if size:  # groups that run over several tasks of a sort
        monkeypatch.setattr(suffix_module, "SORT_BYTES", 20 * size)
        monkeypatch.setattr(suffix_module, "SORT_WINDOWS", size)
    rows = repetitive(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup(df).collect())) == removed(rows)


def test_repeated_strings_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, suffix_dedup(documents).collect())) == removed(rows)
    kept = {r.doc_id: r.kept for r in suffix_dedup(documents, full=True).collect()}
    for d, n, gone, _, _ in removed(rows):
        assert len(kept[d].encode()) <= n - gone


# ---- 9: media --------------------------------------------------------------


def test_media_round_trip(documents, odd):
    for df in (documents, odd):
        texts = texts_of(df)
        for r in M.media_columns(df, full=True).collect():
            data = texts[r.doc_id].encode()
            payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
            assert r.n_bytes == len(data) and r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(r.file).hexdigest() and r.media_bytes == len(r.file)
            assert b"".join(bytes(r.file[p.offset : p.offset + p.length]) for p in r.packets) == payload
            assert [p.timestamp for p in r.packets] == [72 * i for i in range(len(r.packets))]


def test_media_lacing_and_unknown_sizes():
    frames = [b"a" * 5, b"b" * 500, b"c" * 3, b"d" * 70000, b""]
    file = M.mux(frames)
    found = M.demux(file)
    assert [file[p.offset : p.offset + p.length] for p in found.packets] == frames and found.tracks == {1: "A_PCM/INT/LIT"}
    assert [place for _, place in found.cues] == found.clusters
    block = lambda flags, body: M._element(M.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([flags]) + body)
    xiph = block(0x82, b"\x01" + b"\xff\x2d" + b"x" * 300 + b"y" * 7)
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x82\x00\x05\x00" + b"z" * 9))
    open_ended = M._id(M.SEGMENT) + b"\x01" + b"\xff" * 7 + M._id(M.CLUSTER) + b"\xff" + M._uint(M.TIMESTAMP, 1000) + xiph + group + M._element(M.CLUSTER, M._uint(M.TIMESTAMP, 2000) + block(0, b"q"))
    packets = M.demux(open_ended).packets
    # Without a track's entry a file does not tell how long a frame lasts.
    assert [(p.track, p.timestamp, p.length, p.key) for p in packets] == [(1, 1000, 300, True), (1, 1000, 7, True), (2, 1005, 9, True), (1, 2000, 1, False)]


def test_media_times_come_from_the_file():
    lace = lambda frames, relative: M._laced(frames, relative)
    entry = lambda *more: M._element(M.TRACKS, M._element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, 1) + b"".join(more)))
    audio = M._element(M.AUDIO, M._element(M.SAMPLING, struct.pack(">f", 1000.0)) + M._uint(M.CHANNELS, 2) + M._uint(M.BIT_DEPTH, 16))
    frames = [b"a" * 400, b"b" * 400, b"c" * 400]

    def times(scale, *track):
        group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, b"\x81\x00\x09\x00x") + M._uint(M.REFERENCE, 1))
        cluster = M._element(M.CLUSTER, M._uint(M.TIMESTAMP, 10) + lace(frames, 2) + group)
        found = M.demux(M._element(M.SEGMENT, M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, scale)) + entry(*track) + cluster))
        assert [p.key for p in found.packets] == [True] * 3 + [False]
        return [p.timestamp for p in found.packets]

    assert times(1_000_000, M._uint(M.DEFAULT_DURATION, 40_000_000)) == [12, 52, 92, 19]
    assert times(5_000_000, M._element(M.CODEC_ID, b"A_PCM/INT/LIT"), audio) == [60, 160, 260, 95]
    assert times(1_000_000, M._element(M.CODEC_ID, b"V_VP9")) == [12, 12, 12, 19]


# ---- 10: languages ---------------------------------------------------------


def test_languages(documents):
    labels = {r.doc_id: r.lang for r in documents.collect()}
    rows = language_id(documents).collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == labels[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_are_fitted_on_whole_texts(spark):
    head = "notice of the rights and the terms of use " * 120
    rows = [(i, head + ("zwolf boxkampfer jagen viktor quer " if i % 2 else "portez ce vieux whisky au juge blond ") * 40, "de" if i % 2 else "fr") for i in range(60)]
    rows += [(1000, "zwolf boxkampfer jagen viktor quer", None), (1001, "portez ce vieux whisky au juge blond", None)]
    found = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[1000].lang_pred == "de" and found[1001].lang_pred == "fr" and min(found[k].score for k in (1000, 1001)) > 0.9


@pytest.mark.parametrize("size", [0, 3, 1 << 18, (1 << 18) + 2, 600_000])
def test_bucket_counts_of_slices(size):
    text = "".join(random.Random(size).choices("abcdé ", k=size))
    whole = [np.bincount(g, minlength=BUCKETS) for g in hashed_grams(text)]
    assert (bucket_counts([text]) == sum(whole)).all()


def test_language_edge_cases(spark, documents):
    more = spark.createDataFrame([(9001, None), (9002, "123 ..."), (9003, ""), (9004, "the of and " * 40000)], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    both = documents.unionByName(more)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(both).collect()}
    assert got[9001] == got[9002] == got[9003] == ("und", 0.0) and got[9004][0] == "en"
    kept = {r.doc_id for r in keep_identified(both).collect()}
    assert not kept & {9001, 9002, 9003} and kept >= {r.doc_id for r in documents.collect()}
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id(unlabelled).collect()} == {"und"}


def test_scores_equal_a_plain_scorer(spark):
    """Naive Bayes over hashed n-grams, added up one by one."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["der", "hund", "katze", "und"] if i % 2 else ["the", "dog", "cat", "and"], k=30)), "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, "the hund and dog", None), (101, "der cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(df)
    for r in language_id(df).collect():
        text = dict((d, t) for d, t, _ in rows)[r.doc_id].lower()
        total = np.array(model.priors, float)
        for grams in hashed_grams(text):
            for g in grams.tolist():
                total += model.table[g]
        margin = (total - total.max()) / LONGEST
        assert r.lang_pred == model.languages[int(total.argmax())] and abs(r.score - 1 / np.exp(margin).sum()) < 1e-6


# ---- whatever the columns are called ---------------------------------------


CLASHES = ["_doc", "_hash", "_null", "_key", "_score", "_lang_pred", "lang_pred", "c0", "c1", "doc", "text_", "n_bytes", "kept", "Lang"]


def test_columns_of_any_name_survive(spark):
    rng = random.Random(2)
    words = ["the", "and", "that", "with", "from", "there", "house", "water", "under", "never"]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", "s", 0, *(f"{c}{i}" for c in CLASHES[:-1])) for i in range(6)] + [(6, None, "en", "s", 0, *(f"{c}6" for c in CLASHES[:-1]))]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES[:-1]]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for both in (df, df.unionByName(df.filter("doc_id = 3"))):
        for stage in (keep_identified, keep_one_of_each, without_repeats):
            out = stage(both)
            assert out.columns == names
            for r in out.collect():
                assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES[:-1])
    for op in OPERATORS.values():
        assert op(df).count() == (0 if op is L.license_scan else 7) or op is pack_documents


LONG = 8_000_000


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "license_scan"])
def test_very_long_texts(spark, name):
    """One text of 8 MB among short ones is read whole."""
    rng = random.Random(11)
    piece = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(20_000))
    text = (piece + " ") * (LONG // len(piece))
    df = spark.createDataFrame([(1, text, "en", "a"), (2, piece, "en", "a"), (3, "short one", "en", "a")], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in OPERATORS[name](df).collect()}
    assert set(rows) == {1, 2, 3}
    if name == "suffix_dedup":
        assert rows[1].n_bytes == len(text) and rows[1].n_bytes - rows[1].n_removed < 2 * len(piece) + 200 and rows[2].n_removed == rows[2].n_bytes
    if name == "ngram_join":
        assert (rows[1].component_id, rows[2].component_id, rows[1].n_links, rows[3].n_links) == (1, 1, 1, 0)
