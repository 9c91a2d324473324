"""Corpus and span operators: literals with known results, scalar parity and invariants."""

import hashlib
import json
import os
import random

import numpy as np
import literals
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import align, annotate
from lexloom.operators import compile as C
from lexloom.operators import dedup, extract, features, infer, near, near_index, sample, score, shuffle, spans, stats, systems
from lexloom.plans import oracles, queries, round_trips
from lexloom.sources import readers, record_source, weights, writers
from lexloom.streaming import compile_stream, first_stream, stats_stream

DOC = "source string, document_id string, text string"


def sentences_of(spark, text, document_id="1"):
    rows = extract.extract_sentences(spark.createDataFrame([("s", document_id, text)], DOC)).orderBy("sentence_index").collect()
    assert all(text[r.document_start : r.document_end] == r.text for r in rows)
    return [r.text for r in rows]


def test_extraction_literals(spark):
    assert sentences_of(spark, "  昨日は晴れた。\n「映画を見る？」  次です！") == ["昨日は晴れた。", "「映画を見る？」", "次です！"]
    assert sentences_of(spark, "短い。これは十分な長さです。") == ["これは十分な長さです。"]
    assert sentences_of(spark, "食べる🙂か？　　次の文です") == ["食べる🙂か？", "次の文です"]
    assert sentences_of(spark, "text here", "") == [] and sentences_of(spark, "") == []
    assert extract.invalid_documents(spark.createDataFrame([("s", "", "x"), ("s", "1", None), ("s", "1", "x")], DOC)).count() == 2


def test_keys_and_splits(spark):
    df = spark.createDataFrame([("同じ 文です。",), ("同じ 　\n文です。 ",)], "t string")
    assert df.select(X.dedup_key(F.col("t"))).distinct().count() == 1
    docs = spark.range(1000).select(F.lit("test").alias("source"), F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("document_id"))
    rows = docs.select("document_id", X.document_split(F.col("source"), F.col("document_id")).alias("split")).collect()
    assert all(r.split == ("train" if (b := int(hashlib.sha256(f"test\0{r.document_id}".encode()).hexdigest()[:8], 16) % 100) < 85 else "dev" if b < 95 else "test") for r in rows)
    n = {s: sum(r.split == s for r in rows) for s in ("train", "dev", "test")}
    assert 800 <= n["train"] <= 900 and 50 <= n["dev"] <= 150 and 20 <= n["test"] <= 100


def test_hash_constants(spark):
    df = spark.createDataFrame([("昨日🙂",)], "text string")
    r = features.encode_text(df).head()
    assert (r.codepoints, r.bigrams) == ([5065, 5880, 5894], [5638, 4895, 6199]) and sum(len(x) for x in r.categorical) == 66
    with pytest.raises(ValueError):
        X.hash_bucket(F.col("x"), 12)


def test_characters(spark):
    chars = "あア漢aZ5５①。「」、,!?♪+ 　\tーｰ々ぁé ²٣"
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    c = F.col("c")
    got = {r.c: tuple(r)[1:] for r in df.select("c", X.script(c), X.punct_class(c), X.digit_class(c), X.small_kana(c), X.prolonged_mark(c), X.iteration_mark(c)).collect()}
    assert got["あ"][0] == "HIRAGANA" and got["ー"] == ("KATAKANA", "NONE", "NONE", False, True, True) and got["漢"][0] == "KANJI" and got["é"][0] == "OTHER"
    assert [got[x][2] for x in "5５①²٣a"] == ["ASCII", "FULLWIDTH", "OTHER", "OTHER", "OTHER", "NONE"] and [got[x][1] for x in "。「」、,"] == ["SENTENCE", "OPEN", "CLOSE", "COMMA", "COMMA"]
    assert {got[x][0] for x in " 　\t "} == {"WHITESPACE"} and got["+"][0] == "SYMBOL" and got["ぁ"][3]


def simhash(text):
    import re

    value = re.sub(r"\s+", " ", text).strip()
    if not value:
        return 0
    w = [0] * 64
    for i in range(max(1, len(value) - 2)):
        h = int.from_bytes(hashlib.blake2b(value[i : i + 3].encode(), digest_size=8, person=dedup.PERSON).digest(), "big")
        for b in range(64):
            w[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if w[b] >= 0)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("en", "ou", "ist")]
    out = []
    for i in range(60):
        base = " ".join(rng.choice(words) for _ in range(80))
        out.append(base)
        for _ in range(i % 4):
            t = out[-1].split()
            t[rng.randrange(80)] = rng.choice(words)
            out.append(" ".join(t))
    out += [out[0], out[1], "short", "short", "", out[2] + "  "]
    rng.shuffle(out)
    return out


def test_near_duplicates_as_a_scan(spark):
    texts = [*corpus(), None]
    kept, want = {}, []
    for t in texts:
        if t is None:
            want.append("invalid")
        elif t in kept:
            want.append("exact")
        else:
            fp = simhash(t)
            near = len(t) >= 80 and any(len(o) >= 80 and (fp ^ p).bit_count() <= 3 and any((fp ^ p) >> 16 * b & 65535 == 0 for b in range(4)) for o, p in kept.items())
            want.append("near" if near else "kept")
            if not near:
                kept[t] = fp
    rows = [(i, "s", str(i), t) for i, t in enumerate(texts)]
    got = {r.seq: r.disposition for r in dedup.dispositions(spark.createDataFrame(rows, "seq long, " + DOC)).collect()}
    assert got == dict(enumerate(want)) and want.count("near") > 5


def brute_groups(prints, distance):
    """(seq, first, n_links, component_id) of prints {seq: fp}."""
    near = {a: [b for b in prints if b != a and (prints[a] ^ prints[b]).bit_count() <= distance] for a in prints}
    at = {a: a for a in prints}
    while (new := {a: min([at[a], *(at[b] for b in near[a])]) for a in prints}) != at:
        at = new
    return sorted((a, min(b for b in prints if prints[b] == prints[a]), len(near[a]), at[a]) for a in prints)


def test_near_duplicate_groups_query(spark, tmp_path):
    """near_dup_pairs64 against brute force: firsts, numbers of links up to three bits, groups."""
    texts = [*corpus(), None]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    prints = {i: simhash(t) for i, t in enumerate(texts) if t is not None and len(t) >= 80}
    assert {2, 3} <= {(p ^ q).bit_count() for p in prints.values() for q in prints.values()}
    got = queries.QUERIES["near_dup_pairs64"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.first, r.n_links, r.component_id) for r in got) == brute_groups(prints, 3)


@pytest.mark.parametrize("block_rows", [near.BLOCK_ROWS, 3])
def test_near_groups_of_many_links(spark, block_rows):
    """Dense groups, chains and copies, also when a key's rows are dealt out in small blocks; every pair counts once."""
    rng, prints = random.Random(5), {}
    for k in range(240):
        base = rng.choice([0, (1 << 64) - 1, 0x0123456789ABCDEF])
        prints[k * 7 % 251] = base ^ sum(1 << b for b in rng.sample(range(0, 64, 5), rng.randrange(6)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    rows = spark.createDataFrame([*signed, (999, None)], "seq long, fp long").repartition(3)
    got = sorted(map(tuple, near.near_groups(rows, block_rows=block_rows).collect()))
    assert got == [*brute_groups(prints, 3), (999, 999, 0, 999)] and max(r[2] for r in got) > 10
    distinct = {}
    for i in sorted(prints):
        distinct.setdefault(prints[i], i)
    kept, dropped = [], []
    for p, i in sorted(distinct.items(), key=lambda x: x[1]):
        (dropped if any((p ^ q).bit_count() <= 3 for q in kept) else kept).append(p)
    of = {v: p for p, v in distinct.items()}
    only = rows.where(F.col("seq").isin([int(i) for i in of]))
    assert sorted(of[r.seq] for r in near.scan_keeps(only, block_rows=block_rows).collect()) == sorted(dropped)


@pytest.mark.parametrize(("distance", "bits", "blocks"), [(3, 64, 6), (1, 32, 3), (2, 64, 5)])
def test_near_prints_share_a_key(spark, distance, bits, blocks):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        a = rng.getrandbits(bits)
        b = a ^ sum(1 << x for x in rng.sample(range(bits), distance))
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    keys = lambda c: near.block_keys(F.col(c), distance, bits, blocks)
    shared = spark.createDataFrame(rows, "a long, b long").select(F.size(F.array_intersect(keys("a"), keys("b"))).alias("n")).collect()
    assert min(r.n for r in shared) >= 1


def test_index_in_batches_equals_one_scan(spark, tmp_path):
    """Three batches, the index opened anew for each from its folder; a batch that fails in between leaves no trace."""
    texts = [*corpus(), None, "short", "a" * 100, "b" * 79]
    docs = spark.createDataFrame([(i, "s", str(i), t) for i, t in enumerate(texts)], "seq long, " + DOC)
    want = {r.seq: r.disposition for r in dedup.dispositions(docs).collect()}
    folder, got, n = str(tmp_path / "index"), {}, len(texts)
    for k in range(3):
        index = near_index.NearIndex(spark, folder, buckets=3, fanout=2)
        assert index.batches == k
        batch = docs.where((F.col("seq") >= n * k // 3) & (F.col("seq") < n * (k + 1) // 3))
        index._commit, commit = None, index._commit  # fails after its runs are written
        with pytest.raises(TypeError):
            index.add(batch)
        index = near_index.NearIndex(spark, folder, buckets=3, fanout=2)
        for t in spark.catalog.listTables():  # as in a session that has never seen the runs
            if t.name.startswith(index.prefix):
                spark.sql(f"DROP TABLE {t.name}")
        got |= {r.seq: r.disposition for r in index.add(batch).collect()}
    assert got == want and {"near", "exact", "kept", "invalid"} <= set(want.values())
    last = near_index.NearIndex(spark, folder)
    assert last.buckets == 3 and sorted(level for _, _, level in last.runs) == [0, 0, 1, 1]
    keys = sum(t.count() for t in last.of_kind("keys"))
    assert keys == sum(d == "kept" for d in want.values())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = last.near(spark.createDataFrame([(1,)], "fp long"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "hashpartitioning(old_key" not in plan  # runs are not shuffled
    with pytest.raises(ValueError):
        near_index.NearIndex(spark, folder, distance=2)
    assert last.add(docs.limit(0)).count() == 0 and near_index.NearIndex(spark, folder).batches == 4


def test_fingerprints(spark):
    texts = ["昨日は 晴れた。" * 10, "昨日は\n　晴れた。" * 10, "", None, "ab"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(dedup.simhash64("t")).collect()]
    assert got[0] == got[1] and got[2] == 0 and got[3] is None
    assert [g % (1 << 64) for g in (got[0], got[4])] == [simhash(texts[0]), simhash("ab")]


def test_bands_pigeonhole(spark):
    a = 0x1234567890ABCDEF
    df = spark.createDataFrame([(a, a ^ 7)], "a long, b long").select(dedup.bands(F.col("a")).alias("a"), dedup.bands(F.col("b")).alias("b")).head()
    assert len({tuple(x) for x in df.a} & {tuple(x) for x in df.b}) >= 1 and [x.value for x in df.a] == [0xCDEF, 0x90AB, 0x5678, 0x1234]


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shards_are_contiguous(spark, n):
    rows = spark.createDataFrame([(i * 37 % 1009, "t") for i in range(25)], "k long, text string")
    got = sorted((r.k, r.shard, r.line) for r in sample.shards(rows, "k", n).collect())
    sizes = [25 // n + (i < 25 % n) for i in range(n)]
    assert [s for _, s, _ in got] == [i for i in range(n) for _ in range(sizes[i])] and [x[2] for x in got] == list(range(25))


def test_closure_and_partition(spark):
    df = spark.createDataFrame([([2, 9, 0], [2, 4], [4], [4], [])], "a array<int>, b array<int>, bunsetsu array<int>, clause array<int>, sentence array<int>")
    out = spans.nested_boundaries({x: F.col(x) for x in V.LEVELS}, F.lit(4))
    r = df.select(*[c.alias(x) for x, c in out.items()], spans.partition(F.lit(0), F.lit(6), F.array(F.lit(2), F.lit(9), F.lit(2))).alias("p"), spans.partition(F.lit(0), F.lit(0), F.col("b")).alias("none")).head()
    assert (r.a, r.b, r.bunsetsu, r.clause, r.sentence) == ([2, 4], [2, 4], [4], [4], [4]) and [tuple(x) for x in r.p] == [(0, 2), (2, 6)] and r.none == []


def test_trees(spark):
    """Types of nodes, and atoms that hang on a chunk without a B span."""
    span, atom = "array<struct<start:int,end:int>>", "array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>"
    a = [(0, 1, "NOUN_LIKE", None, []), (1, 2, "PARTICLE", "TOPIC", []), (2, 4, "VERB_STEM", None, ["PAST"])]
    rows = [("abcd", a, [(0, 1), (1, 2)], [(0, 2, "TOPIC"), (2, 4, "PREDICATE")], [(0, 4)], [(0, 4)])]
    df = spark.createDataFrame(rows, f"text string, a {atom}, b {span}, c array<struct<start:int,end:int,role:string>>, clause {span}, sentence {span}")
    (s,) = df.select(spans.tree(*[F.col(c) for c in ("text", "a", "b", "c", "clause", "sentence")]).alias("t")).head().t
    assert (s.type, s.text, s.children[0].type) == ("SENTENCE", "abcd", "CLAUSE")
    one, two = s.children[0].children
    assert [(x.type, x.text, [y.atom_type for y in x.children]) for x in one.children] == [("B", "a", ["NOUN_LIKE"]), ("B", "b", ["PARTICLE"])] and one.atoms == []
    assert two.type == "BUNSETSU" and two.role == "PREDICATE" and two.children == [] and [(x.type, x.text, x.inflections) for x in two.atoms] == [("A", "cd", ["PAST"])]
    with pytest.raises(Exception, match="length must be positive"):
        df.select(spans.nested_boundaries({level: F.array(F.lit(1)) for level in V.LEVELS}, F.lit(0))["a"]).collect()


def test_decoding_and_gaps(spark):
    df = spark.createDataFrame([([0.5, 2.0, 2.0], [(1, 3, "A"), (4, 6, "B")])], "l array<double>, c array<struct<start:int,end:int,role:string>>")
    r = df.select(spans.argmax_label(F.col("l"), ["x", "y", "z"]).alias("m"), spans.positive_labels(F.array(F.lit(-1.0), F.lit(0.0), F.lit(2.0)), ["x", "y", "z"]).alias("p"),
                  spans.softmax_confidence(F.col("l")).alias("s"), score.attach_gaps(F.col("c"), F.lit(8), True).alias("n"), score.attach_gaps(F.col("c"), F.lit(8), False).alias("b")).head()
    assert r.m == "y" and r.p == ["y", "z"] and abs(r.s - 1 / (2 + np.exp(-1.5))) < 1e-12
    assert [tuple(x)[:2] for x in r.n] == [(0, 3), (3, 8)] and [tuple(x)[:2] for x in r.b] == [(0, 4), (4, 8)]


def test_compiled_records(spark):
    compiled = C.compile_records(literals.raw(spark)).cache()
    assert compiled.where("(record is null) = (failure is null)").count() == 0
    r = C.records(compiled).head()
    assert r.boundaries.a == [2, 3, 5, 6, 7, 8, 9] and r.bunsetsu[0].role == "TOPIC" and r.spans[-2].inflections == ["PAST"] and r.schema_version == V.SCHEMA_VERSION
    s = stats.summary(compiled).head()
    assert (s.total_sentences, s.successfully_aligned, s.dropped) == (9, 1, 8) and stats.summary(compiled.limit(0)).head().drop_percentage == 0.0
    n = stats.corpus_stats(C.records(compiled), C.failures(compiled))
    assert {(x.metric, x.key): x["count"] for x in n.collect()}[("drop_reason", "length_out_of_range")] == 2


def test_gold_against_itself_scores_one(spark):
    rec = C.records(C.compile_records(literals.raw(spark))).withColumn("id", F.col("document_id"))
    report = score.score_corpus(score.paired(rec, rec, "id")).collect()
    assert all(r.f1 == 1.0 for r in report if r.label in ("macro", "micro", "exact_match") or (r.tp or 0) > 0)
    with pytest.raises(Exception, match="lengths differ"):
        score.paired(rec, rec.limit(0), "id").collect()


def test_counts_equal_a_count_by_character(spark):
    """Overlapping spans, gaps, spans beyond the text, unlisted and null labels, repeated endpoints, texts of unequal length."""
    rng, rows = random.Random(9), []
    for i in range(300):
        text = "x" * rng.randrange(0, 12)

        def spans(labels, *more):
            out = []
            for _ in range(rng.randrange(0, 5)):
                a = rng.randrange(0, 12)
                out.append((a, a + rng.randrange(0, 6), rng.choice(labels), *(m() for m in more)))
            return out

        def record():
            own = text + "y" * rng.randrange(0, 2)
            bounds = tuple([rng.randrange(1, 13) for _ in range(rng.randrange(0, 6))] for _ in V.LEVELS)
            atoms = spans([*V.ATOM_TYPES, "PARTICLE", "VERB_STEM", "NO_TYPE", None], lambda: rng.choice([*V.PARTICLE_FUNCTIONS, None, "NO_FUNCTION"]), lambda: rng.sample([*V.INFLECTIONS, "NO_FLAG"], rng.randrange(0, 4)))
            return (own, bounds, atoms, [(0, 1)], spans([*V.BUNSETSU_ROLES, None, "NO_ROLE"]))

        gold = record()
        rows.append((str(i), gold, gold if rng.random() < 0.2 else record()))
    rec = f"struct<text:string,boundaries:struct<{','.join(f'{x}:array<int>' for x in V.LEVELS)}>,spans:array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>,b_spans:array<struct<start:int,end:int>>,bunsetsu:array<struct<start:int,end:int,role:string>>>"
    pairs = spark.createDataFrame(rows, f"id string, gold {rec}, pred {rec}").repartition(3)

    def last(spans, i, ok=lambda s: True):
        own = [s for s in spans if s[0] <= i < s[1] and ok(s)]
        return own[-1] if own else None

    def characters(r, n):
        for i in range(n):
            atom, role = last(r[2], i), last(r[4], i)
            particle = last(r[2], i, lambda s: s[2] == "PARTICLE")
            inflected = last(r[2], i, lambda s: s[2] in V.INFLECTED)
            yield (atom and atom[2]) or "OTHER", (role and role[2]) or "UNKNOWN", particle and (particle[3] or "UNKNOWN"), inflected and set(inflected[4])

    want = {(m, label): [0, 0, 0] for m, labels in score.LABELS.items() for label in labels}

    def add(metric, label, e, a):
        if (metric, label) in want:
            want[metric, label][0 if e and a else 1 if a else 2] += 1 if e or a else 0

    for _, gold, pred in rows:
        n = min(len(gold[0]), len(pred[0]))
        for e, a in zip(characters(gold, n), characters(pred, n), strict=True):
            for metric, k in (("atom", 0), ("bunsetsu_role", 1), ("particle_function", 2)):
                if e[k] is not None:
                    for label in score.LABELS[metric]:
                        add(metric, label, e[k] == label, a[k] == label)
            if e[3] is not None:
                for label in V.INFLECTIONS:
                    add("inflection", label, label in e[3], label in (a[3] or ()))
        for k, level in enumerate(V.LEVELS):
            for x in {*gold[1][k], *pred[1][k]}:
                add("boundaries", level, x in gold[1][k], x in pred[1][k])
        add("complete_tree", "exact_match", True, gold[1:] == pred[1:])
    got = {(r.metric, r.label): [r.tp, r.fp, r.fn] for r in score.counts(pairs).collect()}
    assert got == want and all(sum(1 for label in labels if sum(want[m, label])) > len(labels) / 2 for m, labels in score.LABELS.items())
    none = score.counts(pairs.limit(0)).collect()
    assert len(none) == len(want) and not any(r.tp or r.fp or r.fn for r in none)
    assert score.tree_exact_match(pairs.limit(0)).head().complete_tree_exact_match == 0.0
    plan = score.score_corpus(score.paired(pairs.select("id", "gold.*"), pairs.select("id", "pred.*"), "id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1


def test_targets_and_padding(spark):
    rec = C.records(C.compile_records(literals.raw(spark)))
    r = features.targets(rec).head()
    assert r.boundary_targets[2] == [1, 1, 1, 0, 0] and r.boundary_targets[8] == [1, 1, 1, 1, 1] and r.function_mask == [False, False, True, False, False, True, False, False, False]
    p = features.padded(spark.createDataFrame([(1, [5] * 9), (1, [7] * 3)], "g int, v array<int>"), "v", ["g"]).orderBy(F.desc("v")).head()
    assert p.v == [7] * 3 + [0] * 6 and p.mask == [True] * 3 + [False] * 6


def test_model_in_numpy():
    assert [infer.parameters(s)["total_parameters"] for s in V.MODEL_SIZES] == [58752, 102392, 134832, 242592]
    rng = np.random.default_rng(0)
    x, decay, mask = rng.normal(size=(2, 12, 5)), rng.normal(size=5), np.arange(12) < np.array([[12], [7]])
    for reverse in (False, True):
        assert np.abs(infer.affine_scan(x, mask.astype(float), decay, reverse) - infer.affine_scan_parallel(x, mask, decay, reverse)).max() < 1e-9
    assert abs(infer.erf(np.array([0.5]))[0] - 0.5204998778) < 2e-7
    outputs = {h: rng.normal(size=(2, 12, n)) for h, n in V.HEADS.items()}
    t = {"mask": mask, "boundaries": rng.integers(0, 2, (2, 12, 5)), "inflection": rng.integers(0, 2, (2, 12, 10)), "inflection_mask": mask, "function_mask": np.zeros_like(mask)} | {k: rng.integers(0, 9, (2, 12)) for k in ("atom", "function", "role")}
    loss = infer.multitask_loss(outputs, t)
    assert loss["function"] == 0 and abs(loss["total"] - sum(V.LOSS_WEIGHTS[k] * loss[k] for k in V.LOSS_WEIGHTS)) < 1e-12


def test_batches_do_not_change_predictions(spark):
    df = features.encode_text(spark.createDataFrame([("a", "食べる"), ("b", "昨日は映画を見た。"), ("c", "x")], "id string, text string"), 4096, 4096)
    w = infer.seeded_weights("50k")
    one, many = ({r.id: r.atom for r in infer.predict(df, w, "id", batch=n).collect()} for n in (1, 64))
    assert all(np.allclose(one[k], many[k], atol=1e-4) for k in one) and len(one["b"]) == 9 * 12


EVERY = "東京へ行った。Yes! 12３²①፩ぁーｰ々「」、,\u3000\u00a0é$€𝄞\t\n½Ⅷ〻ﾞ゛"


def test_texts_are_encoded_alike_in_numpy(spark):
    """Each character of many kinds, and texts of one: buckets, pairs and features equal those of the columns."""
    texts = [*EVERY, EVERY, EVERY[::-1], "a"]
    df = features.encode_text(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 4096, 8192).orderBy("id").collect()
    cp, bg, flags, sizes = features.encoded_texts(texts, 4096, 8192)
    assert sizes.tolist() == [len(t) for t in texts]
    assert cp.tolist() == [x for r in df for x in r.codepoints] and bg.tolist() == [x for r in df for x in r.bigrams]
    assert flags.tolist() == [x for r in df for x in r.categorical]
    every = [chr(c) for c in range(32, 0x3100) if not 0xD800 <= c < 0xE000]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(every)], "i int, c string").orderBy("i").select(X.script(F.col("c"))).collect()]
    own = [V.SCRIPTS[features._own_features(ord(c))[0]] for c in every]
    assert sum(a != b for a, b in zip(got, own, strict=True)) < 40  # of other Unicode versions alone


def test_equal_batches_predict_as_padded_ones(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(EVERY) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    w = weights.Weights.of("50k", infer.seeded_weights("50k"))
    df = spark.createDataFrame([*texts, (900, ""), (901, None)], "id int, text string")
    runs = [{r.id: r for r in infer.predict_texts(df, w, "id", batch, equal).collect()} for batch, equal in ((64, True), (64, False), (7, True), (1, False))]
    old = {r.id: r for r in infer.predict(features.encode_text(df, 4096, 4096), w.unpacked(), "id").collect()}
    for other in [*runs[1:], old]:
        assert set(other) == set(runs[0]) == {i for i, _ in texts}
        assert all(np.allclose(runs[0][i][h], other[i][h], atol=1e-4) for i in other for h in V.HEADS)
    sizes = np.array([len(t) for _, t in texts])
    cut = list(infer.batches_of(sizes, 64, True))
    assert all(len({sizes[i] for i in b}) == 1 and 1 <= len(b) <= 64 for b in cut) and sorted(i for b in cut for i in b) == list(range(300))
    assert [len(b) for b in infer.batches_of(np.full(130, 5), 64, True)] == [64, 64, 2]


def test_weights_as_a_source(spark, tmp_path):
    """Written and read, predictions equal those of the half floats; whatever does not fit is refused."""
    plain = infer.seeded_weights("50k", 5)
    own = weights.Weights.of("50k", plain)
    data, about = own.file()
    for name, x in (("w.gz", data), ("w.bin", own.data), ("w.json", about.encode())):
        (tmp_path / name).write_bytes(x)
    path = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame([(1, "東京へ行った。"), (2, "Yes!")], "id int, text string")
    told = lambda w: {r.id: r.atom for r in infer.predict_texts(rows, w, "id").collect()}
    half = {k: v.astype(np.float16).astype(np.float32) for k, v in plain.items()}
    assert all((own.unpacked()[k] == half[k]).all() for k in half) and own.file() == own.file()
    for name in ("w.gz", "w.bin"):
        read = weights.read_weights(spark, path(name), path("w.json"), "50k")
        assert read == own and told(read) == told(own)
    assert own.unpacked() is own.unpacked()
    with pytest.raises(ValueError, match="model size 50k, not 100k"):
        weights.read_weights(spark, path("w.gz"), path("w.json"), "100k")
    with pytest.raises(ValueError, match="do not fit"):
        weights.Weights.of("50k", plain | {"atom.w": np.zeros((48, 11))})
    with pytest.raises(ValueError, match="do not fit"):
        weights.Weights.of("50k", {k: v for k, v in plain.items() if k != "role.b"})
    with pytest.raises(ValueError, match="unknown model size"):
        weights.Weights.of("51k", plain)
    directory = json.loads(about)
    for change, match in (({"sha256": "0"}, "checksum"), ({"weights": directory["weights"] | {"role.b": {"offset": 0, "shape": [9]}}}, "overlap"), ({"weights": directory["weights"] | {"role.b": {"offset": 1 << 30, "shape": [9]}}}, "outside")):
        (tmp_path / "bad.json").write_text(json.dumps(directory | change))
        with pytest.raises(ValueError, match=match):
            weights.read_weights(spark, path("w.gz"), path("bad.json"), "50k")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a").write_bytes(b"x")
    (tmp_path / "two" / "b").write_bytes(b"x")
    with pytest.raises(ValueError, match="one file"):
        weights.read_weights(spark, path("two"), path("w.json"), "50k")


def test_loss_table_equals_the_losses_of_each_split(spark):
    rng = np.random.default_rng(1)
    rows, held = [], {}
    for i in range(30):
        n, split = int(rng.integers(1, 9)), ["train", "dev", None][i % 3]
        logits = {h: rng.normal(size=(n, k)) for h, k in V.HEADS.items()}
        t = {"boundaries": rng.integers(0, 2, (n, 5)), "inflection": rng.integers(0, 2, (n, 10)), "atom": rng.integers(0, 12, n), "function": rng.integers(0, 12, n), "role": rng.integers(0, 9, n)}
        masks = {"inflection_mask": rng.random(n) < 0.5, "function_mask": np.zeros(n, bool) if split == "dev" else rng.random(n) < 0.5}
        held.setdefault(split, []).append((logits, t | masks | {"mask": np.ones(n, bool)}))
        rows.append((split, *[logits[h].ravel().tolist() for h in infer.HEAD_LOSSES], *[t[h].tolist() for h in infer.HEAD_LOSSES], *[masks[m].tolist() for m in ("function_mask", "inflection_mask")]))
    wide = {"boundaries", "inflection"}
    schema = "split string, " + ", ".join(f"{h} array<double>" for h in infer.HEAD_LOSSES) + ", " + ", ".join(f"{infer.HEAD_TARGETS[h]} " + ("array<array<int>>" if h in wide else "array<int>") for h in infer.HEAD_LOSSES) + ", function_mask array<boolean>, inflection_mask array<boolean>"
    got = {(r.split, r.head): r for r in infer.loss_table(spark.createDataFrame(rows, schema).repartition(4), "split").collect()}
    for split, parts in held.items():
        joined = [{k: np.concatenate([p[i][k] for p in parts]) for k in parts[0][i]} for i in (0, 1)]
        want = infer.multitask_loss(*joined)
        assert all(abs(got[split, h].loss - want[h]) < 1e-12 for h in want)
        assert got[split, "total"].characters == len(joined[1]["mask"]) and got[split, "function"].characters == joined[1]["function_mask"].sum()
    assert len(got) == 18 and got["dev", "function"].loss == 0
    assert infer.loss_table(spark.createDataFrame(rows, schema).limit(0), "split").collect() == []


def test_weights_pack():
    w = {"x": np.arange(5, dtype=np.float32), "y": np.ones((2, 2), np.float32)}
    data, directory = writers.pack_fp16(w)
    back = writers.unpack_fp16(writers.read_weights(writers.reproducible_gzip(data)), directory)
    assert all((back[k] == w[k]).all() for k in w) and writers.reproducible_gzip(data) == writers.reproducible_gzip(data) and len(data) == 20


def test_readers(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.jsonl").write_text('{"id": "1", "text": "x", "title": "T"}\nnot json\n{"id": "2", "text": ""}\n')
    good, bad = readers.wiki_jsonl(spark, str(tmp_path / "w"))
    assert [(r.document_id, r.provenance) for r in good.collect()] == [("1", {"title": "T"})] and bad.count() == 2
    spark.createDataFrame([(1, "x", "en"), (2, None, "en")], "id long, text string, language string").write.parquet(str(tmp_path / "p"))
    good, bad = readers.web_parquet(spark, str(tmp_path / "p"))
    assert good.head().provenance == {"language": "en"} and bad.count() == 1
    with pytest.raises(ValueError, match="missing"):
        readers.web_parquet(spark, str(tmp_path / "w" / ".." / "p2")) if spark.range(1).withColumnRenamed("id", "x").write.parquet(str(tmp_path / "p2")) is None else None
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.conllu").write_text("\n".join(literals.CONLLU) + "\n\n" + "\n".join(literals.CONLLU) + "\n\n")
    assert readers.conllu(spark, str(tmp_path / "g")).count() == 2
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "d.knp").write_text(("\n".join(literals.KNP) + "\nEOS\n") * 2)
    found, missing = readers.knp(spark, str(tmp_path / "k"), spark.createDataFrame([("d",), ("e",)], "document_id string"))
    assert found.count() == 2 and [r[0] for r in missing.collect()] == ["e"]


@pytest.mark.parametrize("ends", ["blank", "eos"])
def test_records_do_not_depend_on_ranges_or_line_ends(spark, tmp_path, ends):
    rng = random.Random(4)
    mark = {"blank": "\n", "eos": "EOS\n"}[ends]
    made = ["\n".join(f"line {rng.randrange(99)} é漢" + "x" * rng.randrange(30) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    text = "".join(r + "\n" + mark * (rng.randrange(1, 4) if ends == "blank" else 1) for r in made)
    want = [r if ends == "blank" else r + "\nEOS" for r in made]
    for name, data in (("lf", text), ("crlf", text.replace("\n", "\r\n")), ("open", text.rstrip("\n") if ends == "blank" else text.removesuffix("EOS\n"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_bytes(data.encode())
        last = want[:-1] + [made[-1]] if name == "open" else want
        for size in (1 << 20, 997, 64, 7, 1):
            got = [r.value for r in record_source.records(spark, str(tmp_path / name), ends, size).collect()] if size > 64 else None
            if got is None:  # without a task for each range
                reader = record_source._Reader({"path": str(tmp_path / name), "ends": ends, "rangebytes": size})
                got = [v for p in reader.partitions() for b in reader.read(p) for v in b["value"].to_pylist()]
            assert got == last, (name, size)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_bytes(b"")
    assert record_source.records(spark, str(tmp_path / "none"), ends).collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        record_source.records(spark, str(tmp_path / "missing"), ends).collect()


def test_gold_files_with_crlf(spark, tmp_path):
    """Two sentences of five tokens each stay two, whatever the line ends; a long record spans many reads."""
    token = lambda k: f"{k}\tw{k}\tl\tNOUN\t_\t_\t0\troot\t_\t_"
    text = "".join(f"# sent_id = s{s}\n" + "\n".join(token(k + 1) for k in range(5)) + "\n\n" for s in range(2))
    for name, data in (("lf", text), ("crlf", text.replace("\n", "\r\n")), ("open", text.rstrip("\n"))):
        (tmp_path / f"{name}.conllu").write_bytes(data.encode())
        got = readers.conllu(spark, str(tmp_path / f"{name}.conllu")).collect()
        assert sorted((r.comments["sent_id"], len(r.tokens)) for r in got) == [("s0", 5), ("s1", 5)]
    knp = "# S-ID:a-1\n* -1D\n+ -1D\n" + "語 ご 語 名詞 6 普通名詞 1 * 0 * 0\n" * 3 + "EOS\n" + "# S-ID:a-2\n* -1D\n+ -1D\n" + "語 ご 語 名詞 6 普通名詞 1 * 0 * 0\n" * 2 + "EOS\n"
    for name, data in (("lf", knp), ("crlf", knp.replace("\n", "\r\n")), ("open", knp.removesuffix("EOS\n"))):
        (tmp_path / f"k{name}").mkdir()
        (tmp_path / f"k{name}" / "doc.knp").write_bytes(data.encode())
        got = readers.knp(spark, str(tmp_path / f"k{name}"))[0].collect()
        assert sorted((r.document_id, r.sentence_id, len(r.tokens), r.b_starts) for r in got) == [("doc", "a-1", 3, [0]), ("doc", "a-2", 2, [0])]
    (tmp_path / "long").write_bytes(b"\n\n".join(b"x" * n for n in (3 << 20, 5, (2 << 20) + 1)))
    sizes = [len(r.value) for r in record_source.records(spark, str(tmp_path / "long"), "blank", 1 << 20).collect()]
    assert sizes == [3 << 20, 5, (2 << 20) + 1]


def test_stream_resumes(spark, tmp_path):
    folder, good, bad, mark = (str(tmp_path / x) for x in ("in", "good", "bad", "mark"))
    os.makedirs(folder)
    lines = [r for r in literals.raw(spark).toJSON().collect()]
    for k, part in enumerate((lines[:5], [*lines[5:], "{broken"])):
        with open(f"{folder}/{k}.jsonl", "w") as f:
            f.write("\n".join(part) + "\n")
        compile_stream.compile_stream(compile_stream.raw_stream(spark, folder), good, bad, mark).awaitTermination()
    assert spark.read.json(good).count() == 1
    reasons = [json.loads(r)["reason"] for r in spark.read.json(bad).toJSON().collect()]
    assert len(reasons) == 9 and "invalid_json" in reasons


def test_statistics_in_one_scan_and_as_a_stream(spark, tmp_path):
    compiled = C.compile_records(literals.raw(spark))
    good, bad = C.records(compiled).withColumn("n", F.monotonically_increasing_id()), C.failures(compiled).withColumn("n", F.monotonically_increasing_id())
    whole = sorted(map(tuple, stats.corpus_stats(good, bad).collect()))
    assert ("sentence_length", "9", 1) in whole and any(m == "drop_reason" for m, _, _ in whole)
    good.write.parquet(str(tmp_path / "once"))
    plan = stats.corpus_stats(spark.read.parquet(str(tmp_path / "once")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert sorted(map(tuple, stats.merged(stats.corpus_stats(good), stats.corpus_stats(good.limit(0)), stats.corpus_stats(good.limit(0), bad)).collect())) == whole
    again = good.unionByName(good)
    folder = {x: str(tmp_path / x) for x in ("good", "bad", "out", "checkpoint")}
    for k in range(2):  # two batches, a restart between them
        good.write.mode("append").parquet(folder["good"])
        (bad if k else bad.limit(0)).write.mode("append").parquet(folder["bad"])
        records, failures = (spark.readStream.schema(df.schema).parquet(folder[x]) for x, df in (("good", good), ("bad", bad)))
        stats_stream.stats_stream(records, failures, folder["out"], folder["checkpoint"]).awaitTermination()
    assert sorted(map(tuple, stats_stream.latest(spark, folder["out"]).select("metric", "key", "count").collect())) == sorted(map(tuple, stats.corpus_stats(again, bad).collect()))


def test_first_writers_in_batches_with_restarts(spark, tmp_path):
    """Three batches, the stream stopped and started after each; firsts of earlier batches stay, whatever comes later."""
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(40)}" if i % 9 else None) for i in range(200)]
    want = {}
    for i, t in rows:
        if t is not None:
            want.setdefault(hashlib.sha256(t.encode()).hexdigest(), i)
    folder = {x: str(tmp_path / x) for x in ("in", "out", "checkpoint")}
    sizes = []
    for k in range(3):
        spark.createDataFrame(rows[k * 70 : (k + 1) * 70], "seq long, text string").repartition(2).write.mode("append").parquet(folder["in"])
        docs = spark.readStream.schema("seq long, text string").parquet(folder["in"])
        first_stream.written(first_stream.first_documents(docs), folder["out"], folder["checkpoint"]).awaitTermination()
        sizes.append(spark.read.parquet(folder["out"]).count())
    got = {r.document_key: r.seq for r in spark.read.parquet(folder["out"]).collect()}
    assert got == want and sizes[-1] == len(want) and sizes[0] < sizes[1] <= sizes[2]
    first_stream.written(first_stream.first_documents(docs), folder["out"], folder["checkpoint"]).awaitTermination()  # nothing new
    assert spark.read.parquet(folder["out"]).count() == len(want)


def brute_buffer(n, slots, seed, epoch, part):
    buffer, out = [], []
    for i in range(n):
        if len(buffer) < slots:
            buffer.append(i)
        else:
            at = int(shuffle.slots_of(np.array([i]), slots, seed, epoch, part)[0])
            out.append(buffer[at])
            buffer[at] = i
    keys = shuffle.slots_of(np.arange(n, n + len(buffer)), 1 << 62, seed, epoch, part)
    return out + [x for _, x in sorted(zip(keys.tolist(), buffer, strict=True))]


@pytest.mark.parametrize(("n", "slots", "sizes"), [(0, 3, [1]), (5, 8, [2]), (500, 1, [7, 60]), (500, 16, [1, 3, 200]), (500, 16, [500]), (300, 300, [40])])
def test_slot_buffer_equals_a_loop(n, slots, sizes):
    buffer, out, at, k = shuffle.SlotBuffer(slots, 7, 2, 1), [], 0, 0
    while at < n:
        to = min(n, at + sizes[k % len(sizes)])
        out += buffer.push(pa.table({"x": list(range(at, to))}))["x"].to_pylist()
        assert buffer.held.num_rows <= slots
        at, k = to, k + 1
    left = buffer.drain()
    out += left["x"].to_pylist() if left is not None else []
    assert out == brute_buffer(n, slots, 7, 2, 1) and sorted(out) == list(range(n))


def test_bounded_shuffle(spark):
    rows = spark.range(0, 5000, numPartitions=3).select("id", F.lit("x").alias("part"))
    order = lambda **by: [r.id for r in shuffle.buffered(rows, 64, **by).orderBy("part", "place").collect()]
    a = order(seed=1)
    assert a == order(seed=1) and sorted(a) == list(range(5000)) and a != sorted(a)
    assert len({tuple(order(seed=s, epoch=e)) for s in (1, 2) for e in (0, 1)}) == 4
    batches = shuffle.seeded_batches(rows, 100, 64, 1).groupBy("part", "batch").count().collect()
    assert sorted(r["count"] for r in batches) == sorted([100] * 48 + [66, 67, 67])
    assert "Exchange" not in shuffle.buffered(rows)._jdf.queryExecution().executedPlan().toString()
    assert shuffle.buffered(rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        shuffle.SlotBuffer(0, 1, 1, 1)


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES | round_trips.QUERIES)


def test_analyze_texts(spark):
    """Spans and trees of texts by seeded weights, against a plain reading of the logits; what is rejected and why."""
    from lexloom.operators import decode

    w = weights.Weights.of("50k", infer.seeded_weights("50k", 3))
    texts = spark.createDataFrame([(1, "東京へ行った。Yes!"), (2, "a"), (3, ""), (4, None), (5, "x" * 129), (6, "一二三 四五六\nabc")], "id int, text string")
    good, bad = decode.analyze(texts, w, "id")
    assert {(r.id, r.reason[:14]) for r in bad.collect()} == {(3, "text must be n"), (4, "text must be n"), (5, "text exceeds 1")}
    rows = good.collect()
    assert {r.id for r in rows} == {1, 2, 6}
    for r in rows:
        n = len(r.text)
        logits = {h: np.array(r[h]).reshape(n, k) for h, k in V.HEADS.items()}
        ends, level = {n}, {}
        for k in range(4, -1, -1):
            ends = ends | {i + 1 for i in range(n) if logits["boundaries"][i, k] >= 0}
            level[V.LEVELS[k]] = sorted(ends)
        assert r.levels.asDict() == level
        for s, a, b in zip(r.spans, [0, *level["a"]], level["a"], strict=False):
            kind = V.ATOM_TYPES[logits["atom"][b - 1].argmax()]
            want = [x for x, v in zip(V.INFLECTIONS, logits["inflection"][b - 1], strict=True) if v >= 0] if kind in decode.INFLECTED else []
            assert (s.start, s.end, s.atom_type, s.inflections) == (a, b, kind, want)
            assert s.function == (V.PARTICLE_FUNCTIONS[logits["function"][b - 1].argmax()] if kind == "PARTICLE" else None)
        assert r.root == ("SENTENCE" if len(level["sentence"]) == 1 else "DOCUMENT")
        leaves = [x for s in r.tree for c in s.children for k in c.children for g in k.children for x in g.children]
        assert "".join(x.text for x in leaves) == r.text and [x.atom_type for x in leaves] == [s.atom_type for s in r.spans]
    none = spark.createDataFrame([("ab", None, None, None, None, None)], "text string, boundaries array<double>, atom array<double>, function array<double>, inflection array<double>, role array<double>")
    (r,) = decode.decoded(none).collect()
    assert [(s.end, s.atom_type, s.function, s.inflections) for s in r.spans] == [(2, "OTHER", None, [])] and [c.role for c in r.bunsetsu] == ["UNKNOWN"]
    assert decode.equal_length_batch(["ab", "cd"]) == 2
    for wrong in ([], ["a"] * 65, ["a", "bc"], [""], ["x" * 129]):
        with pytest.raises(ValueError):
            decode.equal_length_batch(wrong)


def test_firsts_of_many_copies(spark):
    from lexloom.operators import dedup, extract

    s = spark.createDataFrame([("k", d, i) for d in range(50) for i in range(3)] + [("m", 9, 1)], "dedup_key string, document_id int, sentence_index int").repartition(5)
    assert {tuple(r) for r in extract.first_of_each_sentence(s, F.col("document_id"), F.col("sentence_index")).collect()} == {("k", 0, 0), ("m", 9, 1)}
    d = spark.createDataFrame([(i, "same") for i in range(20)] + [(30, "other")], "seq int, text string").repartition(4)
    assert {r.seq for r in dedup.first_copies(d).where("is_first").collect()} == {0, 30}


def test_shards_of_skewed_and_null_orders(spark):
    rows = spark.createDataFrame([(k, str(k)) for k in [*range(50), 10**15, None, None]], "k long, text string").repartition(5)
    cut = sample.shards(rows, "k", 4).persist()
    got = sorted((r.line, r.shard, r.k) for r in cut.collect())
    assert [line for line, _, _ in got] == list(range(53)) and [k for _, _, k in got] == [*range(50), 10**15, None, None]
    assert [sum(s == i for _, s, _ in got) for i in range(4)] == [14, 13, 13, 13]
    manifest = sample.shard_manifest(cut)
    assert [r.k for r in sample.merged(manifest, cut.where("line % 3 > 0"), cut.where("line % 3 = 0")).collect()] == [k for line, _, k in got if line % 3]
    for part in (cut.where("shard < 3"), cut.where("line <> 20"), cut.unionByName(cut.where("line = 0").withColumn("shard", F.lit(9)))):
        with pytest.raises(ValueError, match="do not add up"):
            sample.merged(manifest, part, cut.limit(0))
    swapped = cut.withColumn("text", F.when(F.col("line") == 0, "1").when(F.col("line") == 1, "0").otherwise(F.col("text")))
    a, b = ({r.shard: r.sha256 for r in sample.shard_manifest(x).collect()} for x in (cut, swapped))
    assert a[0] != b[0] and [a[i] for i in (1, 2, 3)] == [b[i] for i in (1, 2, 3)]
    assert sample.shards(rows.limit(0), "k", 4).count() == 0


def test_ranks_over_many_bins(spark, monkeypatch):
    monkeypatch.setattr(sample, "BIN_ROWS", 10)
    rows = spark.range(1000).select(F.lit("train").alias("split"), F.when(F.col("id") % 3 == 0, 32).otherwise(64).alias("bucket"), (F.col("id") * 7 % 100).alias("k"), "id").repartition(6)
    got = {(r.bucket, r.k, r.id): r.position for r in sample.batches(rows, 1, "k", "id").collect()}
    for bucket in (32, 64):
        own = sorted(x for x in got if x[0] == bucket)
        assert [got[x] for x in own] == list(range(len(own)))
    assert len(got) == 1000


def test_training_arrays_are_padded(spark, tmp_path):
    records = spans.surrogate_records(spark.createDataFrame([("ab cd", "s", str(i), 0) for i in range(20)], "text string, source string, document_id string, sentence_index int"))
    writers.training_arrays(records, str(tmp_path / "arrays"))
    split = spark.read.parquet(str(tmp_path / "arrays")).first().split
    row = readers.training_arrays(spark, str(tmp_path / "arrays"), split).first()
    for c in features.ARRAYS:
        assert len(row[c]) == 32 and len(row["mask"]) == 32
    assert sum(row["mask"]) == 5 and row["codepoints"][5:] == [0] * 27 and row["boundary_targets"][31] == [0] * 5
    assert readers.training_arrays(spark, str(tmp_path / "arrays"), split, "codepoints").columns == ["bucket", "mask", "codepoints"]


def test_named_inputs():
    assert readers.named_input("web=/a/b=c") == ("web", "/a/b=c")
    for bad in ("web", "=x", "web="):
        with pytest.raises(ValueError, match="SOURCE=PATH"):
            readers.named_input(bad)


def test_quotas_have_inputs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}")
    inputs = {"web": str(tmp_path / "a.jsonl"), "wiki": str(tmp_path / "*.jsonl")}
    assert sorted(map(tuple, readers.quota_inputs(spark, {"web": "5", "wiki": 7}, inputs).collect())) == [("web", 5), ("wiki", 7)]
    for quotas, paths, match in (({"web": "five"}, inputs, "integer: web=five"), ({"web": 1, "b": 2, "a": 3}, inputs, "missing inputs: a, b"), ({"web": 1}, inputs | {"old": str(tmp_path / "no")}, "does not exist: old")):
        with pytest.raises(ValueError, match=match):
            readers.quota_inputs(spark, quotas, paths)


def test_annotations_and_common_rows(spark):
    def load():
        def analyse(text):
            if "x" in text:
                raise ValueError("no x")
            return {"words": text.split(), "n": len(text)}

        return annotate.each(analyse)

    rows = spark.createDataFrame([(1, "a b"), (2, "x"), (3, None), (4, "")], "id long, text string")
    out = annotate.annotated(rows, load, spark.createDataFrame([], "words array<string>, n long").schema)
    assert [(r.id, r.words, r.n) for r in annotate.successes(out, "id").orderBy("id").collect()] == [(1, ["a", "b"], 3), (4, [], 0)]
    assert {r.id: r.error for r in annotate.failures(out, "id").collect()} == {2: "ValueError: no x", 3: "no text"}
    both = score.common_rows({"one": annotate.successes(out, "id"), "two": rows.where("id < 4")}, "id")
    assert [[r.id for r in b.collect()] for b in both.values()] == [[1], [1]]


def test_a_failing_batch_is_halved():
    calls = []

    def analyse(texts):
        calls.append(len(texts))
        if any(t.startswith("bad") for t in texts):
            raise RuntimeError("a bad text")
        return [{"t": t} for t in texts]

    texts = [f"good {k}" for k in range(64)]
    assert annotate.told(analyse, texts) == [({"t": t}, None) for t in texts] and calls == [64]
    texts[5] = texts[40] = "bad"
    calls.clear()
    out = annotate.told(analyse, texts)
    assert [i for i, (r, _) in enumerate(out) if r is None] == [5, 40] and out[5][1] == "RuntimeError: a bad text" and out[6] == ({"t": "good 6"}, None)
    assert calls[0] == 64 and len(calls) == 1 + 2 + 2 * 2 * 5
    assert annotate.told(lambda t: t[:1], ["a", "b"]) == [("a", None), ("b", None)] and annotate.told(analyse, []) == []


def test_surfaces_are_shown_as_python_does(spark):
    texts = ["a", "it's", 'a "b"', "both ' and \"", "back\\slash", "tab\tline\nreturn\r", "\x01\x7f\x85\xa0\xad", "\u3000\u200b\u2028", "𝄞\U000e0001", "é漢", " ", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", align._quoted(F.col("t")).alias("shown")).orderBy("i").collect()
    assert [r.shown for r in got] == [repr(t) for t in [*texts, None]]


def test_predictions_of_systems(spark):
    token = lambda s, start=None, end=None, pos=("名詞",): (s, start, end, list(pos), s, "", {})
    a = [token("ab"), token("", 2, 2), token(" "), token("が", pos=("助詞", "格助詞"))]
    rows = [("1", "ab が", a, [token("ab "), token("が")]), ("2", "abc", [token("ab")], [token("abc")]), ("3", "abc", [token("abc")], [token("abd")]), ("4", "abc", None, [token("abc")])]
    good, bad = systems.token_predictions(spark.createDataFrame(rows, "id string, text string, " + systems.TOKENS), "id")
    r = good.collect()
    assert len(r) == 1 and r[0].boundaries.asDict() == {"a": [2, 3, 4], "b": [3, 4], "bunsetsu": [4], "clause": [4], "sentence": [4]}
    assert [(s.start, s.end, s.atom_type, s.function) for s in r[0].spans] == [(0, 2, "NOUN_LIKE", None), (2, 3, "NOUN_LIKE", None), (3, 4, "PARTICLE", "SUBJECT_CASE")]
    assert {r.id: r.error for r in bad.collect()} == {"2": "a teacher_does_not_cover_text covered 2/3 codepoints", "3": "b surface_mismatch at raw offset 0: 'abd'", "4": "no tokens"}

    c = lambda start, end, dependency="obj", topic=False, predicate=False: (start, end, dependency, topic, predicate)
    rows = [
        ("1", " ab  cd ", [c(1, 3, topic=True), c(5, 7, "ROOT")]), ("2", "abcd", [c(0, 2), c(3, 4)]), ("3", "ab", []), ("4", "ab", None), ("5", "abcd", [c(0, 3)]), ("6", "abcd", [c(0, 3), c(2, 4)]), ("7", "ab", [c(0, 3)]),
    ]
    df = spark.createDataFrame(rows, "id string, text string, " + systems.CHUNKS)
    for to_next, want in ((True, [(0, 3), (3, 8)]), (False, [(0, 5), (5, 8)])):
        good, bad = systems.chunk_predictions(df, "id", to_next)
        r = good.collect()
        assert len(r) == 1 and [(x.start, x.end) for x in r[0].bunsetsu] == want and [x.role for x in r[0].bunsetsu] == ["TOPIC", "PREDICATE"] and r[0].boundaries.bunsetsu == [e for _, e in want]
        assert {r.id: r.error for r in bad.collect()} == {"2": "text not covered at 2", "3": "no chunks", "4": "no chunks", "5": "text not covered at 3", "6": "text not covered at 3", "7": "text not covered at 0"}


def test_report_has_quotas(spark):
    docs = spark.createDataFrame([("a", "1", "t", "kept")], "source string, document_id string, text string, disposition string")
    s = spark.createDataFrame([("a",), ("a",)], "source string")
    quotas = spark.createDataFrame([("a", 5), ("b", 2)], "source string, quota int")
    got = {r.source: r.asDict() for r in stats.build_report(docs, s, s.limit(1), s.limit(1), quotas).collect()}
    assert (got["a"]["documents"], got["a"]["duplicates"], got["a"]["requested"], got["a"]["selected"], got["a"]["shortfall"]) == (1, 1, 5, 1, 4)
    assert (got["b"]["documents"], got["b"]["selected"], got["b"]["shortfall"]) == (0, 0, 2)
