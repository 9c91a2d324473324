"""What large tables need of the corpus operators: work that grows with the rows, and the same results as plain readings."""

import hashlib
import re
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import annotate, decode, dedup, extract, features, infer, runs, score, spans, systems, validate
from lexloom.plans import queries, surrogates
from lexloom.sources.weights import Weights


def _md5_print(texts: list[str]) -> int:
    votes = [0] * 32
    for text in texts:
        t = re.sub(f"[{X.WS}]+", " ", text).strip(" ")
        for gram in [t[i : i + 3] for i in range(max(1, len(t) - 2))] if t else []:
            h = int(hashlib.md5(gram.encode()).hexdigest()[:8], 16)
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if v >= 0)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_md5_prints_count_grams_in_tasks_and_match_a_plain_reading(spark):
    long = "".join(chr(97 + i * i % 23) + (" " if i % 7 == 0 else "") for i in range(150000))
    rows = [("a", "one two  three\n"), ("b", "x"), ("b", "a second text of b"), ("c", " \n"), ("d", None), ("e", "ねこ😀 は"), (None, "no id"), ("f", long), ("g", "")]
    df = spark.createDataFrame(rows, "document_id string, text string")
    begin = time.time()
    told = dict(map(tuple, dedup.simhash_md5(df).collect()))
    assert time.time() - begin < 30  # arrays of grams took minutes
    want = {k: _md5_print([t for i, t in rows if i == k and t]) for k in ("a", "b", "e", None, "f")}
    assert told == want
    assert "Generate" not in _plan(dedup.simhash_md5(df))


def test_near_pairs_meet_at_narrow_keys(spark):
    """All prints agree in one band, so a join by bands compares all with all."""
    prints = [(i, (i * 40503 & 0xFFFF) << 16 | 7) for i in range(3000)] + [(3000, 5 << 16 | 7), (3001, 5 << 16 | 7)]
    df = spark.createDataFrame(prints, "seq long, fp long")
    pairs = dedup.near_pairs(df, distance=1, width=16, bits=32)
    first = {}
    for i, p in prints:
        first.setdefault(p, i)
    near = {tuple(sorted((i, first[q]))) for p, i in first.items() for q in (p ^ (1 << b) for b in range(32)) if q in first}
    copies = {(first[p], i) for i, p in prints if first[p] != i}
    told = [tuple(r) for r in pairs.collect()]
    assert len(told) == len(set(told)) and set(told) == near | copies
    assert "Join [band" not in _plan(pairs)
    with pytest.raises(ValueError):
        dedup.near_pairs(df, distance=2, width=16, bits=32)


def test_python_strips_the_white_space_of_the_class():
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    space = re.compile(f"[{X.WS}]")
    assert [c for c in every if c.isspace()] == [c for c in every if space.match(c)]


def test_sentences_of_long_documents_are_cut_in_arrow_batches(spark):
    text = "".join(f" \u3000s{i}" + "xy" * (i % 90) + "。」!?\r\n"[i % 5 :] for i in range(4000))
    df = spark.createDataFrame([("s", "1", text), ("s", "2", ""), ("s", None, "no id."), (None, "3", "none."), ("s", "4", "tail 😀 without end")], "source string, document_id string, text string")
    rows = extract.extract_sentences(df).collect()
    want = []
    for doc, t in (("1", text), ("4", "tail 😀 without end")):
        at = k = 0
        for piece in re.findall(X.PIECE.replace("\\z", "\\Z"), t):
            own = piece.strip()
            if 4 <= len(own) <= 128:
                want.append((doc, k, t.index(own, at), own))
                k += 1
            at += len(piece)
    assert sorted((r.document_id, r.sentence_index, r.document_start, r.text) for r in rows) == sorted(want)
    assert all(r.document_end == r.document_start + len(r.text) for r in rows) and {r.source for r in rows} == {"s"}
    assert "regexp_extract_all" not in _plan(extract.extract_sentences(df)) and extract.extract_sentences(df.where(F.lit(False))).count() == 0


def _no_array_functions(df) -> bool:
    return not re.search(r"lambda|namedlambdavariable", _plan(df))


def test_decoded_arrays_make_the_tree_of_the_spans(spark):
    rng = np.random.default_rng(5)
    texts = ["ab", "x", "ねこ😀は 走った。", "many words and more of them"]
    logits = lambda n, k: [float(x) for x in rng.normal(-0.4 if k == 5 else 0, 1, n * k)]
    rows = [(i, t, *(logits(len(t), k) for k in V.HEADS.values())) for i, t in enumerate(texts * 5)]
    rows += [(90, "no heads", None, None, None, None, None), (91, "cut", [1.0, None], [float("nan")], [], [None] * 30, [0.5] * 27)]
    df = spark.createDataFrame(rows, "id int, text string, " + ", ".join(f"{h} array<double>" for h in V.HEADS))
    out = decode.decoded(df)
    assert _no_array_functions(out)
    told = out.withColumn("want", spans.tree(*[F.col(c) for c in ("text", "spans", "b_spans", "bunsetsu", "clauses", "sentences")])).collect()
    for r, own in zip(sorted(told, key=lambda r: r.id), rows, strict=True):
        assert r.tree == r.want
        n, bound = len(own[1]), own[2] or []
        level = {n}
        for k in reversed(range(5)):
            at = [i * 5 + k for i in range(n)]
            level |= {i + 1 for i, j in enumerate(at) if j < len(bound) and bound[j] is not None and bound[j] >= 0}
            assert r.levels[V.LEVELS[k]] == sorted(level)
        for s in r.spans:
            own_logits = (own[3] or [])[12 * (s.end - 1) : 12 * s.end]
            assert s.atom_type == (V.ATOM_TYPES[int(np.argmax(own_logits))] if own_logits else "OTHER")
    assert {s.atom_type for s in next(r for r in told if r.id == 91).spans} == {"NOUN_LIKE", "OTHER"}
    with pytest.raises(Exception, match="length must be positive"):
        decode.decoded(df.withColumn("text", F.lit(""))).collect()


def test_targets_are_painted_once(spark):
    span = "array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>"
    schema = f"text string, boundaries struct<a:array<int>,b:array<int>,bunsetsu:array<int>,clause:array<int>,sentence:array<int>>, spans {span}, bunsetsu array<struct<start:int,end:int,role:string>>"
    own = [(0, 3, "PARTICLE", "TIME", None), (1, 2, "VERB_STEM", None, ["PAST", "odd", None]), (2, 9, "strange", "strange", []), (None, 5, "NUMBER", None, []), (3, 3, "NUMBER", None, [])]
    rows = [("abcde", ([1, 5, 9, 0], None, [2], [], [5]), own, [(0, 4, "TOPIC")]), ("xy", None, None, None)]
    df = features.targets(spark.createDataFrame(rows, schema))
    assert _no_array_functions(df)
    r, none = sorted(df.collect(), key=lambda r: -len(r.text))
    assert r.boundary_targets == [[1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0] * 5, [0] * 5, [1, 0, 0, 0, 1]]
    unknown = V.PARTICLE_FUNCTIONS.index("UNKNOWN")
    assert r.atom_targets == [V.ATOM_TYPES.index("PARTICLE"), V.ATOM_TYPES.index("VERB_STEM"), -1, -1, -1]
    assert r.function_targets == [V.PARTICLE_FUNCTIONS.index("TIME"), unknown, -1, -1, -1]
    assert r.inflection_targets == [[0] * 10, [1] + [0] * 9, [0] * 10, [0] * 10, [0] * 10]
    assert r.role_targets == [0, 0, 0, 0, V.BUNSETSU_ROLES.index("UNKNOWN")]
    assert r.function_mask == [True, False, False, False, False] and r.inflection_mask == [False, True, False, False, False]
    assert none.atom_targets == [V.ATOM_TYPES.index("OTHER")] * 2 and none.boundary_targets == [[0] * 5] * 2 and none.function_mask == [False] * 2


def test_tree_edges_read_records_once(spark):
    schema = "id int, text string, boundaries struct<a:array<int>,b:array<int>,bunsetsu:array<int>,clause:array<int>,sentence:array<int>>"
    df = spark.createDataFrame([(1, "abcdef", ([2, 4, 2, 9], [3], [], None, [6])), (2, "xy", ([1], [1], [1, 2], [2], [2]))], schema)
    out = spans.tree_edges(df, "id")
    want = {(1, "a", 0, 2, 0, 3), (1, "a", 2, 4, None, None), (1, "a", 4, 6, 3, 6), (1, "b", 0, 3, 0, 6), (1, "b", 3, 6, 0, 6), (1, "bunsetsu", 0, 6, 0, 6), (1, "clause", 0, 6, 0, 6)}
    want |= {(2, level, a, b, a, b) for level in ("a", "b") for a, b in ((0, 1), (1, 2))} | {(2, "bunsetsu", 0, 1, 0, 2), (2, "bunsetsu", 1, 2, 0, 2), (2, "clause", 0, 2, 0, 2)}
    assert {tuple(r) for r in out.collect()} == want
    assert "Union" not in _plan(out) and _no_array_functions(out)


def test_texts_are_dealt_to_all_tasks_before_the_model(spark):
    """Sizes in bytes would bring a shuffled table of short texts into one task."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string").repartition(1)
    out = infer.predict_texts(df.distinct(), Weights.of("50k", infer.seeded_weights("50k")), "id").select("id", F.spark_partition_id().alias("p"))
    assert len({r.p for r in out.collect()}) > 1


def test_training_rows_are_padded_in_one_pass(spark):
    span = "array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>"
    schema = f"source string, document_id string, text string, boundaries struct<a:array<int>,b:array<int>,bunsetsu:array<int>,clause:array<int>,sentence:array<int>>, spans {span}, bunsetsu array<struct<start:int,end:int,role:string>>"
    row = lambda k, t: ("s", str(k), t, ([1, len(t)], [len(t)], [], [], [len(t)]), [(0, 1, "PARTICLE", "TIME", []), (1, len(t), "AUXILIARY", None, ["PAST"])], [(0, len(t), "TOPIC")])
    rows = [row(k, "aé 、😀は"[: k % 6 + 1] * (k % 20 + 1)) for k in range(40)]
    df = features.bucketed(spark.createDataFrame([*rows, ("s", "90", "", None, None, None)], schema))
    want = features.padded_to_bucket(features.targets(features.encode_text(df)), *features.ARRAYS)
    told = features.training_rows(df)
    columns = ["document_id", "split", "bucket", "mask", *features.ARRAYS]
    assert sorted(told.select(columns).collect()) == sorted(want.select(columns).collect()) and told.count() == 40
    assert _plan(told).count("ArrowEvalPython") == 1 and _no_array_functions(told)


def test_spans_are_read_where_logits_are_made(spark):
    """Logits, some 400 bytes a character, pass through Spark only if they are asked for."""
    df = spark.createDataFrame([(i, "東京へ行った。Yes! "[i % 7 :] * (i % 5 + 1)) for i in range(60)] + [(90, ""), (91, None)], "id int, text string")
    w = Weights.of("50k", infer.seeded_weights("50k", 3))
    want = {r.id: (r.spans, r.bunsetsu, r.tree) for r in decode.analyze(df, w, "id")[0].collect()}
    for equal in (True, False):
        good, bad = decode.analyze(df, w, "id", equal, only=("spans", "bunsetsu", "tree"))
        assert good.columns == ["id", "text", "spans", "bunsetsu", "tree"] and _plan(good).count("MapInArrow") == 1 and "ArrowEvalPython" not in _plan(good)
        assert {r.id: (r.spans, r.bunsetsu, r.tree) for r in good.collect()} == want and len(want) == 60 and bad.count() == 2


def test_records_are_compiled_of_whole_batches(spark):
    """Alignment, labels and checks as array functions took most of the time; the analysers' stand-in told a dict a token."""
    from lexloom.operators import compile as C
    from lexloom.plans import surrogates

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aB1 ,.é漢😀;\nxyzwv"), rng.integers(1, 40))) for _ in range(600)] + ["   ", " a", ",,", "."]
    told = surrogates.raw_arrays(pa.array(texts)).to_pylist()
    for r in told:
        for t in (r["sudachi_a"] or []) + (r["sudachi_b"] or []):
            t["context"] = dict(t["context"])
    assert told == surrogates.raw_analyser()(texts)
    rows = [(t, "s", str(i), *r.values(), None, None, None) for i, (t, r) in enumerate(zip(texts, told, strict=True))]
    out = C.compile_records(spark.createDataFrame([*rows, (None, "s", "none", None, None, None, None, None, None)], C.RAW))
    assert _plan(out).count("ArrowEvalPython") == 1 and _no_array_functions(out)
    for r in out.collect():
        assert (r.record is None) != (r.failure is None)
        if r.record:
            assert [r.text[s.start : s.end] for s in r.record.spans] == [t.surface for t in r.sudachi_a] and r.record.boundaries.a == [s.end for s in r.record.spans]
        elif r.text and 4 <= len(r.text) <= 128:
            assert r.failure.reason == ("teacher_boundary_disagreement" if r.sudachi_a and r.ginza_bunsetsu else "teacher_missing")


def test_coded_pairs_are_made_without_shuffles(spark, tmp_path):
    """Code points came of Spark's arrays of characters, and both records of a sentence met in a join of all their spans."""
    from lexloom.plans import queries as Q

    rows = [(k, "s", "An é漢😀 text, with words. " * (k % 3 + 1) + "x?") for k in range(12)] + [(90, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    pairs = Q._coded_pairs(spark, str(tmp_path))
    assert _no_array_functions(pairs) and "Join" not in _plan(pairs) and _no_array_functions(Q._coded(Q._identified(spark, str(tmp_path))))
    found = pairs.collect()
    assert len(found) == Q._identified(spark, str(tmp_path)).count() > 0
    for r in found:
        for side, off in ((r.gold, 0), (r.pred, 1)):
            points = [ord(c) + (off if ord(c) % 3 == 0 else 0) for c in side.text]
            ends = [i + 1 for i, c in enumerate(points) if i + 1 == len(points) or any(c % m == 0 for m in Q.DECODE_MODULI)]
            assert side.id == r.id and side.boundaries.a == ends and [s.atom_type for s in side.spans] == [V.ATOM_TYPES[points[e - 1] % 12] for e in ends]


def test_knp_blocks_are_read_and_labelled_of_whole_batches(spark):
    """Array functions split a token's line for each of its fields, and summed lengths anew for each token."""
    from lexloom.operators import gold
    from lexloom.sources import readers

    line = lambda w, pos, form="*": " ".join([w, w, w, pos, "0", "*", "0", "*", "0", form, "0"])
    blocks = [("\n".join(["# S-ID:s1 x", "* -1D", "+ -1D", line("犬", "名詞"), line("は", "助詞"), "", "* 0D", "+ 0D", line("走る", "動詞", "タ形"), "odd line", "+ 1D"]), "d"), ("no head", "d"), ("# S-ID:s2", "d"), (None, "d")]
    out = gold.knp_records(readers.knp_blocks(spark.createDataFrame(blocks, "value string, document_id string")))
    assert _no_array_functions(out)
    (r,) = out.collect()
    assert (r.text, r.sentence_id, [x.role for x in r.bunsetsu], [x.function for x in r.spans]) == ("犬は走る", "s1", ["TOPIC", "PREDICATE"], [None, "TOPIC", None])
    assert [tuple(x) for x in r.b_spans] == [(0, 2), (2, 4), (None, 4)] and r.spans[2].inflections == ["PAST"] and r.errors[0] == "b_boundaries_not_sorted_unique"


def test_analysers_of_arrays_say_what_those_of_texts_say():
    texts = ["ab cd, ef. gh", "  a", "., !x ", "ねこ😀 12 words", "tens of chars", "x" * 11, "y" * 13, "", "    ", "ten letters", "a,b", ";;", "é 1"]
    for load, analyse in ((surrogates.token_analyser, surrogates.token_arrays), (surrogates.chunk_analyser, surrogates.chunk_arrays)):
        want = [r for t in texts for r, _ in annotate.told(load(), [t])]
        found, why = annotate.told_arrays(analyse, pa.array([*texts, None]))
        told = [{"chunks": x} if isinstance(x, list) else x and {k: [t | {"context": dict(t["context"])} for t in v] for k, v in x.items()} for x in found.to_pylist()]
        assert told == [*want, None]
        assert why.to_pylist() == [*(None if x else "no record" for x in want), "no text"]

    def raising(x: pa.Array) -> pa.Array:
        if "bad" in x.to_pylist():
            raise RuntimeError("a bad text")
        return pa.array([len(t) for t in x.to_pylist()], pa.int64())

    assert [x.to_pylist() for x in annotate.told_arrays(raising, pa.array(["a", "bad", "cde"]))] == [[1, None, 3], [None, "RuntimeError: a bad text", None]]


def test_systems_are_compared_in_one_pass_without_shuffled_records(spark):
    texts = ["ab cd, ef. gh", "one of 12 words; more", "x" * 11, "y" * 13, "(it is) so.", "1,2, tens of it!", "ten letters to go"]
    s = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    coded = queries._coded(s)
    told = lambda load, schema: annotate.successes(annotate.annotated(s, load, spark.createDataFrame([], schema).schema), "id", "text")
    tokens = systems.token_predictions(told(surrogates.token_analyser, systems.TOKENS), "id")[0]
    chunks = systems.chunk_predictions(told(surrogates.chunk_analyser, systems.CHUNKS), "id")[0]
    assert _no_array_functions(tokens) and _no_array_functions(chunks)
    common = score.common_rows({"gold": coded, "tokens": tokens, "chunks": chunks, "same": coded}, "id")
    common["combined"] = score.combined_prediction(common["tokens"], common["chunks"], "id")
    want = set()
    for name in ("tokens", "chunks", "same", "combined"):
        one = score.score_corpus(score.paired(common["gold"], common[name], "id"))
        want |= {(name, *r) for r in (systems.scoped(one, systems.SCOPES[name]) if name in systems.SCOPES else one).collect()}
    out = systems.compared(coded, tokens, chunks, "id", same=coded)
    assert {tuple(r) for r in out.collect()} == want
    assert ("same", "complete_tree", "exact_match", None, None, None, None, None, 1.0) in want and len(common["gold"].collect()) == 3
    one = systems.compared_batches(s, queries._analysed)
    assert _plan(one).count("MapInArrow") == 1 and "Join" not in _plan(one)
    assert {tuple(r) for r in one.collect()} == {r for r in want if r[0] != "same"}
    none = systems.compared_batches(s.where("id < 0"), queries._analysed).collect()
    assert len(none) == len(one.collect()) and not any(r.f1 for r in none)


def test_faulty_records_are_made_and_checked_of_whole_batches(spark, tmp_path):
    texts = [("ab, cd 12. ねこ😀 (is) of? " * 3)[i % 7 : i % 7 + 4 + i % 50] for i in range(200)]
    want = queries._coded_arrays(pa.array(texts)).to_pylist()
    for t, r in zip(texts, want, strict=True):
        k, bounds, own = len(t) % 13, r["boundaries"], r["spans"]
        r["text"] = None if k == 1 else t
        r["boundaries"] = None if k == 2 else bounds | ({"a": bounds["a"][::-1]} if k == 3 else {"b": None} if k == 12 else {})
        for fault, field, x in ((6, "atom_type", "NOUN"), (7, "function", "WHO"), (8, "inflections", ["WAS"])):
            own[0][field] = x if k == fault else own[0][field]
        own[-1]["end"] += k == 10
        r["spans"] = None if k == 4 else own[1:] if k == 11 else own
        r["bunsetsu"][0]["role"] = "VERB" if k == 9 else r["bunsetsu"][0]["role"]
        r["bunsetsu"] = None if k == 5 else r["bunsetsu"]
    made = {c: x.to_pylist() for c, x in queries._faulty(pa.array(texts)).items()}
    assert [{c: made[c][i] for c in r} for i, r in enumerate(want)] == want and {len(t) % 13 for t in texts} == {*range(13)}
    schema = "text string, " + queries.CODED
    r = spark.createDataFrame(want, schema).select(F.array_join(validate.violations(*[F.col(c) for c in ("text", "boundaries", "spans", "b_spans", "bunsetsu")]), ","))
    assert [x[0] for x in r.collect()] == queries._fault_codes(pa.array(texts)).to_pylist()
    spark.createDataFrame([(1, "web", "ab, cd 12. of (it) is.")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert _no_array_functions(queries.validate_codes(spark, str(tmp_path))) and queries.validate_codes(spark, str(tmp_path)).count() == 1


def test_code_points_of_slices_and_nulls():
    texts = ["a😀", "", None, "ねこ", "z"]
    for own in (texts, texts[3:], [], [""]):
        for x in (pa.array(own, pa.string()), pa.array(own, pa.large_string()), pa.array(["before", *own], pa.string())[1:]):
            assert runs.points_of(x).tolist() == [ord(c) for t in own for c in t or ""]


def test_logits_do_not_depend_on_the_batch():
    """In single precision some of a hundred moved in their last bits with the shape of a batch, and at last a span over zero."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aB1 ,.é漢😀;ねこ\nxyzwv"), rng.integers(1, 129))) for _ in range(400)]
    for size in ("50k", "150k"):
        cp, _, bg, _, _ = V.MODEL_SIZES[size]
        w = Weights.of(size, infer.seeded_weights(size)).unpacked()
        *inputs, sizes = features.encoded_texts(texts, cp, bg)
        want = infer._logits(w, inputs, sizes, 64, True)
        for most, equal in ((64, False), (7, False), (1, True)):
            told = infer._logits(w, inputs, sizes, most, equal)
            assert all((told[h] == want[h]).all() for h in V.HEADS)
        # unrounded, and at every place of a block
        n, row = int(sizes[0]), [x[None, : sizes[0]] for x in inputs]
        alone = infer.forward(w, *row, np.ones((1, n), bool))
        for k in range(3):
            wide = [np.concatenate([np.roll(x[None, -n:], 1)] * k + [r, r], 0) for x, r in zip(inputs, row, strict=True)]
            many = infer.forward(w, *wide, np.ones((k + 2, n), bool))
            assert all(x.dtype == np.float64 and (many[h][k:] == x).all() for h, x in alone.items())


def test_texts_that_share_an_id_are_not_mixed_up(spark, tmp_path, monkeypatch):
    """Spans were compared by a hash of the text alone."""
    from lexloom.plans import round_trips

    rows = [(k, "s", f"An é漢 text of {k} words. And one more!") for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(round_trips.F, "xxhash64", lambda c: F.length(c).cast("long"))
    (told,) = round_trips.weights_in_use(spark, str(tmp_path)).collect()
    assert tuple(told) == (6, 0, 0)


def test_arrays_are_made_in_pieces(spark):
    """What was made of a batch of 10,000 rows, some kilobytes each, was held by the worker and by Spark as a whole."""
    df = spark.range(0, 5000, 1, 1).select("id", F.concat(F.lit("text "), "id").alias("text"))
    told = lambda x: runs.struct(held=pa.array([len(x)] * len(x)), own=x)
    one = runs.with_fields(df, told, "held bigint, own string", "text").collect()
    two = runs.with_fields(df, lambda x, i: runs.struct(held=pa.array([len(x)] * len(x)), own=x, i=i), "held bigint, own string, i bigint", "text", "id").collect()
    assert len(one) == len(two) == 5000 and max(r.held for r in one + two) <= runs.PIECE_ROWS
    assert all(r.own == r.text for r in one + two) and all(r.i == r.id for r in two)
    wide = runs.with_fields(df.where("id < 50").withColumn("text", F.repeat("text", F.lit(20000))), told, "held bigint, own string", "text").collect()
    assert len(wide) == 50 and max(r.held for r in wide) < 20 and all(r.own == r.text for r in wide)
    assert runs.with_fields(df.limit(0), told, "held bigint, own string", "text").collect() == []


def test_training_arrays_are_not_sorted(spark, tmp_path):
    """Rows were put in the order of the folders after their arrays were made, some 250 bytes a place."""
    from lexloom.sources import writers

    rows = [("s", str(k), "aé 、😀は"[: k % 6 + 1] * (k % 20 + 1)) for k in range(300)]
    s = spark.createDataFrame(rows, "source string, document_id string, text string").repartition(3)
    paths = [str(tmp_path / x) for x in ("records", "texts")]
    writers.training_arrays(queries._coded(s), paths[0])
    writers.training_arrays(s, paths[1], make=queries._own_coded)
    one, two = (sorted(map(repr, spark.read.parquet(p).select("split", "bucket", "mask", *features.ARRAYS).collect())) for p in paths)
    assert one == two and len(one) == 300
    told = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [p for p in (told.apply(i).physicalPlanDescription() for i in range(told.size())) if "WriteFiles" in p]
    for p in plans[-2:]:
        p = p.split("Initial Plan")[1].split("\n\n")[0]
        assert "Sort" not in p[: p.index("ArrowEvalPython")] and p.count("Sort") == 1


def test_losses_are_taken_where_logits_are_made(spark, tmp_path):
    """Logits and targets, some 500 bytes a character, went through Spark in batches of 10,000 texts."""
    rows = [("a" if k % 3 else None, "".join("aB1 ,.é漢😀ねこ"[(k + i * i) % 11] for i in range(1 + k % 90))) for k in range(3000)]
    df = spark.createDataFrame([*rows, ("b", ""), ("b", None)], "split string, text string").repartition(2)
    held = tmp_path / "held"
    held.mkdir()

    def make(text: pa.Array):
        (held / f"{len(text)}").touch()
        return queries._loss_arrays(text)

    out = infer.loss_table(df, "split", make=make)
    assert _plan(out).count("MapInArrow") == 1 and "ArrowEvalPython" not in _plan(out)
    there = df.where("length(text) > 0")
    coded = runs.with_fields(there, queries._other_coded, queries.CODED, "text")
    given = runs.with_fields(features.targets(coded), queries._logit_arrays, ", ".join(f"{h} array<double>" for h in V.HEADS), "text")
    want = {(r.split, r.head): r for r in infer.loss_table(given, "split").collect()}
    told = {(r.split, r.head): r for r in out.collect()}
    assert {k for k in told if k[0] != "b"} == set(want) and len(want) == 12
    assert all(told[k].characters == r.characters and abs(told[k].loss - r.loss) < 1e-12 for k, r in want.items())
    assert all(told["b", h].characters == 0 and told["b", h].loss == 0 for h in V.HEADS)
    assert max(int(p.name) for p in held.iterdir()) <= runs.PIECE_ROWS
    one, two = (sorted(x.select("text", "spans", "tree", "root").where("length(text) < 9").collect()) for x in (decode.decoded(there, queries._logit_arrays), decode.decoded(given)))
    assert one == two and len(one) > 100
    spark.createDataFrame([(k, "s", f"text {k}") for k in range(9)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "Scan ExistingRDD" not in _plan(queries.model_loss(spark, str(tmp_path)))


def test_logits_are_held_in_pieces(spark, monkeypatch):
    """The logits of 10,000 texts were held at once, and sent to Spark as one batch."""
    texts = ["ab c" * (k % 30 + 1) for k in range(3000)] + ["x" * 70000]
    part = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    told = list(infer._by_length(part))
    assert sorted(i for p in told for i in p["id"].to_pylist()) == [*range(3001)] and [len(t) for p in told for t in p["text"].to_pylist()] == sorted(map(len, texts))
    assert all(sum(map(len, p["text"].to_pylist()[:-1])) <= infer.PIECE_CHARS for p in told) and len(told) > 2
    assert list(infer._by_length(part.slice(0, 0))) == []
    df = spark.createDataFrame(list(enumerate(texts[:600])), "id long, text string").repartition(1)
    w = Weights.of("50k", infer.seeded_weights("50k", 3))
    out = infer.predict_texts(df, w, "id", make=lambda text, logits, sizes: {"held": pa.array([int(sizes.sum())] * len(text))}, schema="held long").collect()
    assert len(out) == 600 and max(r.held for r in out) <= infer.PIECE_CHARS + 128
