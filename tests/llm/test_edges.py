"""Edge cases of the ten operators: clashing column names, reruns, ids above 2^53, very long and repeated texts, and the
registered queries on tables of a few rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join, line_dedup, prefix_forest, quality, source_mix, token_planes, toxicity, url_filter
from lexloom.llm import queries as llm

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ta", "re", "mi", "so", "ku") for b in ("no", "la", "vé", "X", "9")]
LONG = " ".join(WORDS[k * k % 25] + str(k % 997) for k in range(60_000))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(8, 50)) for _ in range(24)]
    texts += [texts[0], LONG, LONG + " more", None, "", " \n ", "line that repeats here\n" + texts[1], "line that repeats here\n" + texts[2]]
    out = [(i, t, "en", f"s{i % 3}" if i % 6 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[4], "en", "s1", 1), (5, "another text of a repeated id", "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """A folder of tables: documents with ids of their own, labels, pages, benchmark, embeddings."""
    rng, path = random.Random(22), tmp_path_factory.mktemp("tables")
    own = [(i, t, *r) for i, (_, t, *r) in enumerate(rows)]
    own += [(100 + k, " ".join(["idiot", "scum", "moron", *prose(rng, 30).split()]), "en", "s2", 1) for k in range(30)]
    spark.createDataFrame(own, DOC).write.parquet(str(path / "documents.parquet"))
    labels = [(r[0], int(r[0] % 2), int(r[0] >= 100)) for r in own]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(7, " ".join(own[6][1].split()[:9])), (12, LONG[5000:5400])], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    urls = ["http://a.org/x", None, "http://a.com/fr/1", "http://a.com/fr/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(path / "pages.parquet"))
    x = np.random.default_rng(3).normal(size=(240, 6)).tolist()
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").write.parquet(str(path / "embeddings.parquet"))
    return str(path), own, x


def test_mix_agrees_in_any_partitioning(docs):
    every = [sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in source_mix.mix_words(d).collect()) for d in (docs, docs.repartition(7, "doc_id"), docs.orderBy("text").coalesce(1))]
    assert every[0] == every[1] == every[2] and len(every[0]) == docs.count()


def test_many_rows_alike_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 70 + [(2, "d e", "en", "s", 3)] * 5 + [(3, "f", "en", None, 1)], DOC)
    kept, source_mix.NUMBERS = source_mix.NUMBERS, 8
    try:
        got = source_mix.mix_words(docs).collect()
    finally:
        source_mix.NUMBERS = kept
    assert Counter(r.doc_id for r in got) == {1: 70, 2: 5, 3: 1}
    assert abs(sum(r.taken for r in got if r.doc_id != 3) - [r.target for r in got if r.doc_id == 1][0]) <= 3


def test_no_column_name_is_taken(spark, docs, rows):
    own = lambda *names: docs.select("doc_id", "text", "source", *[docs.lang.alias(n) for n in names])
    extra = lambda df, *names: {tuple(r) for r in df.select(*names).distinct().collect()} == {("en",) * len(names)}
    names = ("key", "_key", "row", "id", "row_id", "size", "number")
    assert extra(source_mix.mixed(own(*names)), *names)
    bench = spark.createDataFrame([(1, "line that repeats here")], "item_id long, text string")
    names = ("words", "spans", "items", "_words", "_items", "_spans")
    clean = decontaminate.decontaminated(own(*names), bench)
    assert extra(clean, *names) and clean.count() == len(rows)
    names = ("_line", "line", "gone", "id", "at", "positions")
    kept = line_dedup.dedup_lines(own(*names))
    assert extra(kept, *names) and kept.count() == len(rows)
    pages = spark.createDataFrame([(1, "http://a.com/fr/1", "x")], "page_id long, url string, salt string")
    assert [(r.salt, r.rule) for r in url_filter.url_verdicts(pages, spark.createDataFrame(url_filter.RULES, "entry string, verdict string")).collect()] == [("x", "com/fr/")]


def test_hot_lines_by_broadcast_agree(docs):
    plain = {(r.doc_id, tuple(r.positions)) for r in line_dedup.dropped_lines(docs).collect()}
    assert plain == {(r.doc_id, tuple(r.positions)) for r in line_dedup.dropped_lines(docs, hot_lines=1).collect()} and plain


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    """What goes is decided by id and key, row by row: no row loses a line that only it holds."""
    rows = [
        (1, "a shared long line here\nfirst text of one"), (2, "a shared long line here\nsecond line of two"), (2, "precious unique line alpha\nshort\nshort"),
        (2, "precious unique line beta\na shared long line here"), (2, "precious unique line beta\na shared long line here"), (3, "short\nA SHARED long line here \n\tsecond line of two"),
        (None, "null row of one unique line"), (None, "another null row\na shared long line here\nshort"), (None, "another null row"), (None, None), (None, ""), (4, "another null row\nshort"),
    ]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    at = lambda i: line_dedup.LAST if i is None else i
    least = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            least[key(x)] = min(at(i), least.get(key(x), line_dedup.LAST))
    want = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or least[key(x)] == at(i)]
        want.append((i, t, "\n".join(kept), len(own), len(own) - len(kept)))
    for batches in (1, 3):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=batches, buckets=2)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_hot_pages(spark):
    pages = spark.createDataFrame([(i, "http://a.com/fr/1" if i % 3 else None) for i in range(300)], "page_id long, url string")
    got = url_filter.url_verdicts(pages, spark.createDataFrame(url_filter.RULES, "entry string, verdict string")).collect()
    assert Counter((r.rule, r.verdict) for r in got) == {("com/fr/", "allow"): 200, (None, "allow"): 100}


def test_neighbours_with_ids_beyond_doubles(spark):
    x = np.random.default_rng(6).normal(size=(40, 4)).tolist()
    top = 1 << 53
    vectors = spark.createDataFrame([(top, x[0]), (top + 1, x[0]), *[(k, v) for k, v in enumerate(x) if k]], "vec_id long, embedding array<double>")
    got = prefix_forest.neighbours(vectors, vectors.where(f"vec_id >= {top}"), k=3).where("rank = 1").collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(top, top + 1, 0.0), (top + 1, top, 0.0)}


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(23)
    bad = lambda: " ".join(["idiot", "scum", "moron", *prose(rng, 30).split()])
    rows = [(i, bad() if i % 4 == 0 else prose(rng, 33), "en", "s", 1) for i in range(200)]
    rows += [(None, bad(), "en", "s", 1), (None, prose(rng, 30), "en", "s", 1), (4, "a clean text of a repeated id", "en", "s", 1), (901, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, text_key string, no_id long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows if "idiot" not in (r[1] or ""))


def test_templates_link_as_brute_force_says(spark):
    """Documents of one template, whose own parts and sizes differ: many are just below, at or above the threshold."""
    rng = random.Random(8)
    template, other = [f"w{k}" for k in range(70)], [f"v{k}" for k in range(40)]
    texts = []
    for k in range(260):
        own = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 16))]
        base = (template if k % 4 else other)[rng.randrange(0, 4) : rng.choice([None, -2, -7])]
        at = rng.randrange(len(base) + 1)
        texts.append(" ".join([*base, *own] if k % 3 else [*base[:at], *own, *base[at:]]))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    near = {i: [j for j in range(len(sets)) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(len(sets))}
    at = list(range(len(sets)))
    while (new := [min(at[j] for j in near[i]) for i in range(len(at))]) != at:
        at = new
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(s), at[i]) for i, s in enumerate(sets)]
    assert 20 < len(set(at)) < 250


def test_pairs_of_templates_are_not_listed(spark):
    """Two thousand documents that share most of their text, none of which link, give no pair at any token."""
    rows = [(k % 7, 100 * t + k, 197, 23 + k % 7, 100 * t + k, 0) for t in range(20) for k in range(100)]
    mixed = spark.createDataFrame(rows, "token long, doc_id long, n long, pos long, component long, main long")
    plan = jaccard_join._apart(mixed)
    assert plan.count() == 0
    near = mixed.withColumn("pos", F.when(F.col("doc_id") < 4, 3).otherwise(F.col("pos")))
    assert {(r.a, r.b) for r in jaccard_join._apart(near.withColumn("token", F.lit(1))).collect()} == {(a, b) for a in range(4) for b in range(4) if a < b}


def test_boilerplate_of_every_document_comes_last():
    """A shingle spread one a document counts as frequent by its cell, so it leaves the prefixes."""
    rng = np.random.default_rng(7)
    common = rng.integers(1, 1 << 62, 1, dtype=np.uint64)
    sets = [np.unique(np.append(rng.integers(1, 1 << 62, 300, dtype=np.uint64), common)) for _ in range(2000)]
    cells = np.zeros(jaccard_join.CELLS)
    for s in sets:
        cells += np.bincount(jaccard_join._cell(s), minlength=jaccard_join.CELLS)
    over = cells - np.median(cells)
    over[over < jaccard_join.HOT * np.sqrt(np.median(cells)) + jaccard_join.FREQUENT] = 0
    none = np.zeros(0, np.uint64)
    rank = jaccard_join.ranked(sets[0], none, none.astype(np.int64), over.astype(np.int64))
    assert rank[sets[0] == common[0]][0] > 1000 and np.mean(rank == 0) > 0.95


def test_registered_queries_on_small_tables(spark, folder):
    """Each query's columns, held-out rows and predictions; results of those without SQL against brute force."""
    path, own, x = folder
    texts = {r[0]: r[1] or "" for r in own}
    crc = lambda i: zlib.crc32(str(i).encode())
    for name, modulus, held in (("op3_quality", 3, 1), ("op10_toxicity", 5, 0)):
        got = llm.QUERIES[name](spark, path).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        assert all(r.held_out == (crc(r.doc_id) % modulus == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id for r in got if r.predicted} == {i for i, t in texts.items() if "idiot" in t}

    got = llm.QUERIES["op5_lm_score"](spark, path).collect()
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), None] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if crc(i) % 10 for w in t)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(tokens[r.doc_id]), sum(w in counts for w in tokens[r.doc_id]), sum(counts.values()))
        assert r.score < 0 and np.isfinite(r.score)

    got = llm.QUERIES["op8_prefix_forest"](spark, path).collect()
    x = np.array(x)
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in best] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 and v != q for _, v, s in best)
        assert len({v for _, v, _ in best} & set(np.argsort(d)[1:11].tolist())) >= 8

    got = llm.QUERIES["op9_source_mix"](spark, path).collect()
    words = {i: len(t.split()) for i, t in texts.items()}
    assert sorted((r.doc_id, r.size) for r in got) == sorted(words.items()) and all(r.taken in (0, r.size, 2 * r.size) for r in got)

    got = llm.QUERIES["op7_line_dedup"](spark, path).collect()
    assert {r.doc_id: r.n_lines for r in got} == {i: len(t.split("\n")) for i, t in texts.items()}
    got = {r.doc_id: r for r in llm.QUERIES["op2_decontaminate"](spark, path).collect()}
    assert got[6].contaminated and got[25].contaminated and got[26].contaminated and got[25].n_words == 60_000
    got = {r.doc_id: r for r in llm.QUERIES["op4_jaccard_join"](spark, path).collect()}
    assert got[26].component_id == 25 and got[24].component_id == 0 and sorted(got) == sorted(texts)
    assert Counter(r.verdict for r in llm.QUERIES["op1_url_filter"](spark, path).collect()) == {"allow": 4}


def test_long_texts_in_tokens(spark, folder):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, own, _ = folder
    tokenizer, start = Tokenizer.from_file(token_planes.default_tokenizer()), 0
    kept, token_planes.REMEMBERED = token_planes.REMEMBERED, 100
    try:
        got = sorted(llm.QUERIES["op6_token_ids"](spark, path).collect(), key=lambda r: r.start)
    finally:
        token_planes.REMEMBERED = kept
    for r, (i, t, *_) in zip(got, sorted(own), strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_remembered_segments_are_kept_right():
    """Forgetting all but the most used segments never changes ids."""
    pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    rng, encoder = random.Random(24), token_planes.Encoder(token_planes.default_tokenizer())
    kept, token_planes.REMEMBERED = token_planes.REMEMBERED, 50
    try:
        for _ in range(6):
            texts = [prose(rng, 30) + "  é x!\n\n y " for _ in range(20)] + ["", None]
            ids, sizes = encoder.encode(pa.array(texts))
            want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    finally:
        token_planes.REMEMBERED = kept


def test_pipeline_with_odd_rows(spark, rows, tmp_path):
    """Nulls, empty and very long texts, repeated ids and empty tables pass through every stage."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    for name, some in (("some", rows), ("none", [])):
        path = tmp_path / name
        spark.createDataFrame(some, DOC).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([(r[0], 1, 0) for r in some if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        spark.createDataFrame([(1, "no such words at all")] if some else [], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(path)).collect()
        assert bool(got) == bool(some) and all(r.n_tokens > 1 for r in got)
        # what each stage makes of all rows of the one before
        left, key = [spark.read.parquet(str(path / "documents.parquet"))], lambda r: (str(r[0]), str(r[1]))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            stage(spark, left[-1], str(path)).write.parquet(str(path / str(k)))
            left.append(spark.read.parquet(str(path / str(k))))
            assert left[-1].columns == left[0].columns
        before, toxic, joined, clean, mixed = ([tuple(r) for r in df.collect()] for df in left)
        assert sorted(toxic, key=key) == sorted(before, key=key)  # no row is marked toxic
        lost = Counter(toxic) - Counter(joined)
        own = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]) for i, t, *_ in toxic if i is not None]
        sets = [(i, {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))}) for i, w in own if w]
        at = {i: i for i, _ in sets}
        links = [(i, j) for i, x in sets for j, y in sets if 100 * len(x & y) >= 85 * len(x | y)]
        for _ in at:
            for i, j in links:
                at[i] = at[j] = min(at[i], at[j])
        assert not Counter(joined) - Counter(toxic) and {r[0] for r in lost} == {i for i in at if at[i] < i}
        assert sum(lost.values()) == sum(1 for r in toxic if r[0] in at and at[r[0]] < r[0])
        assert sorted(clean, key=key) == sorted(joined, key=key)  # no passage of the benchmark
        times = Counter(mixed)
        assert set(times) <= set(clean) and all(n <= 2 * Counter(clean)[r] for r, n in times.items()) and not any(not (r[1] or "").strip() for r in mixed)
        assert len(got) == len(mixed)


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (None, "x"), (1, "y z")], "doc_id long, text string")
    learn = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, fold int")
    got = quality.quality(docs, learn).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
