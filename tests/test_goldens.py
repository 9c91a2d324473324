"""Literal morphology with known results: Japanese records, gold blocks and labels, which the tables do not hold."""

import pytest
from pyspark.sql import functions as F

import literals
from lexloom.functions import labels as L
from lexloom.functions import vocabulary as V
from lexloom.operators import align, features, gold, score, stats, synth, validate
from lexloom.operators import compile as C
from lexloom.plans.queries import _gold, _shown
from lexloom.sources import readers

ALIGN_SURFACES = [
    ('exact', None, 5, '0-2,2-3,3-4,4-5,5-6'),
    ('skips', 'surface_mismatch', 1, None),
    ('empty', 'empty_surface', 1, None),
    ('half', 'invalid_teacher_offsets', 0, None),
    ('back', 'non_monotonic_offset', 1, None),
    ('other', 'surface_offset_mismatch', 0, None),
    ('short', 'teacher_does_not_cover_text', 2, None),
    ('none', 'teacher_does_not_cover_text', 0, None),
]
MAP_LABELS = [
    ('proper', 'PROPER_LIKE', None, '', 'CASED_NOMINAL'),
    ('number', 'NUMBER', None, '', 'MODIFIER'),
    ('verb', 'VERB_STEM', None, '', 'PREDICATE'),
    ('copula', 'COPULA', None, 'PAST', 'UNKNOWN'),
    ('ni', 'PARTICLE', 'UNKNOWN', '', 'UNKNOWN'),
    ('ni_time', 'PARTICLE', 'TIME', '', 'CASED_NOMINAL'),
    ('to_quote', 'PARTICLE', 'QUOTATIVE', '', 'CONNECTIVE'),
    ('to', 'PARTICLE', 'COMITATIVE', '', 'CONNECTIVE'),
    ('o', 'PARTICLE', 'OBJECT', '', 'CASED_NOMINAL'),
    ('wa', 'PARTICLE', 'TOPIC', '', 'TOPIC'),
    ('yo', 'PARTICLE', 'OTHER', '', 'UNKNOWN'),
    ('nakatta', 'AUXILIARY', None, 'NEGATIVE', 'UNKNOWN'),
    ('ta', 'AUXILIARY', None, 'PAST', 'UNKNOWN'),
    ('nakere', 'AUXILIARY', None, 'CONDITIONAL,NEGATIVE', 'UNKNOWN'),
    ('masen', 'AUXILIARY', None, 'NEGATIVE,PAST,POLITE', 'UNKNOWN'),
    ('none', 'OTHER', None, '', 'UNKNOWN'),
]
VALIDATE_CODES = [
    ('valid', ''),
    ('empty', 'text_missing_or_empty'),
    ('no_boundaries', 'boundaries_missing'),
    ('unsorted', 'a_boundaries_not_sorted_unique,a_spans_do_not_match_a_boundaries'),
    ('far', 'a_boundary_out_of_range,a_spans_do_not_match_a_boundaries'),
    ('hole', 'nesting_b_not_subset_of_previous,b_boundaries_missing_in_a'),
    ('gap', 'a_spans_not_contiguous,a_spans_do_not_match_a_boundaries'),
    ('beyond', 'a_span_out_of_range,a_spans_do_not_cover_text,a_spans_do_not_match_a_boundaries'),
    ('bad_atom', 'invalid_atom_type'),
    ('bad_function', 'invalid_particle_function'),
    ('bad_inflection', 'invalid_inflections'),
    ('bad_role', 'invalid_bunsetsu_role'),
    ('no_spans', 'spans_missing_or_not_list'),
    ('no_bunsetsu', 'bunsetsu_missing_or_not_list'),
    ('null_level', 'b_boundaries_not_list,b_spans_do_not_match_b_boundaries,bunsetsu_boundaries_missing_in_b'),
    ('no_cover', 'a_spans_do_not_cover_text,a_spans_do_not_match_a_boundaries'),
]
COMPILE_RECORDS = [
    ('good', 0, 0, 2, 'NOUN_LIKE', None, ''),
    ('good', 1, 2, 3, 'PARTICLE', 'TOPIC', ''),
    ('good', 2, 3, 5, 'NOUN_LIKE', None, ''),
    ('good', 3, 5, 6, 'PARTICLE', 'OBJECT', ''),
    ('good', 4, 6, 7, 'VERB_STEM', None, ''),
    ('good', 5, 7, 8, 'AUXILIARY', None, 'PAST'),
    ('good', 6, 8, 9, 'PUNCT_SYMBOL', None, ''),
]
COMPILE_FAILURES = [
    ('one_b', 'teacher_boundary_disagreement', 'cross_teacher', 'bunsetsu endpoints absent from b: [3, 6, 8]'),
    ('short', 'length_out_of_range', 'raw', 'length=3'),
    ('long', 'length_out_of_range', 'raw', 'length=129'),
    ('no_b', 'teacher_missing', 'sudachi_b', ''),
    ('gap', 'surface_mismatch', 'sudachi_a', "at raw offset 2: '映画'"),
    ('cut', 'teacher_does_not_cover_text', 'sudachi_a', 'covered 8/9 codepoints'),
    ('clause', 'teacher_boundary_disagreement', 'cross_teacher', 'clause endpoints absent from bunsetsu: [4]'),
    ('beyond', 'surface_offset_mismatch', 'sudachi_a', "'昨日'"),
]
UD_GOLD = [
    ('x', 0, 0, 'CASED_NOMINAL,PREDICATE', 'NOUN_LIKE', None, ''),
    ('x', 1, 0, 'CASED_NOMINAL,PREDICATE', 'PARTICLE', 'OBJECT', ''),
    ('x', 2, 0, 'CASED_NOMINAL,PREDICATE', 'VERB_STEM', None, ''),
    ('x', 3, 0, 'CASED_NOMINAL,PREDICATE', 'AUXILIARY', None, 'PAST'),
    ('x', 4, 0, 'CASED_NOMINAL,PREDICATE', 'PUNCT_SYMBOL', None, ''),
]
KNP_GOLD = [
    ('d', 0, 0, 'CASED_NOMINAL,PREDICATE', 'NOUN_LIKE', None, ''),
    ('d', 1, 0, 'CASED_NOMINAL,PREDICATE', 'PARTICLE', 'OBJECT', ''),
    ('d', 2, 0, 'CASED_NOMINAL,PREDICATE', 'VERB_STEM', None, 'PAST'),
    ('d', 3, 0, 'CASED_NOMINAL,PREDICATE', 'PUNCT_SYMBOL', None, ''),
]
TARGET_ARRAYS = [
    ('good', '0,0,5,0,0,5,2,6,10', '11,11,0,11,11,2,11,11,11', '0,0,0,1,1,1,2,2,6'),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def known(want):
    return sorted(want, key=str)


def test_alignments(spark):
    r = literals.alignments(spark)
    a = align.align(F.col("text"), F.col("tokens"), "t")
    told = r.select("id", a.alias("a")).select("id", "a.reason", "a.token_index", _shown(F.transform("a.spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))))
    assert rows(told) == known(ALIGN_SURFACES)


def test_labels(spark):
    function = L.particle_function(F.col("surface"), F.col("pos"), F.col("case"))
    told = literals.labels(spark).select("id", L.atom_type(F.col("pos")), function, _shown(L.inflections(F.col("surface"), F.col("normalized"), F.col("form"))), L.bunsetsu_role(F.col("dependency"), function, F.col("predicate")))
    assert rows(told) == known(MAP_LABELS)


def test_codes(spark):
    told = literals.records(spark).select("id", _shown(validate.violations(F.col("text"), F.col("boundaries"), F.col("spans"), F.col("b_spans"), F.col("bunsetsu"))))
    assert rows(told) == known(VALIDATE_CODES)


def test_compilation(spark):
    compiled = C.compile_records(literals.raw(spark))
    r = C.records(compiled).select("document_id", F.posexplode("spans").alias("i", "s")).select("document_id", "i", "s.start", "s.end", "s.atom_type", "s.function", _shown(F.col("s.inflections")))
    assert rows(r) == known(COMPILE_RECORDS)
    assert rows(C.failures(compiled).select("document_id", "reason", "teacher", "detail")) == known(COMPILE_FAILURES)
    s = stats.summary(compiled).head()
    assert (s.total_sentences, s.successfully_aligned, s.dropped, s.drop_percentage) == (9, 1, 8, 800 / 9)


def test_gold_blocks(spark):
    assert rows(_gold(gold.ud_records(readers.conllu_blocks(literals.conllu(spark))))) == known(UD_GOLD)
    assert rows(_gold(gold.knp_records(readers.knp_blocks(literals.knp(spark))))) == known(KNP_GOLD)


def test_targets(spark):
    n = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    r = features.targets(C.records(C.compile_records(literals.raw(spark)))).select("document_id", n("atom_targets"), n("function_targets"), n("role_targets"))
    assert rows(r) == known(TARGET_ARRAYS)


def test_paradigms(spark):
    lexicon = literals.lexicon(spark)
    told = synth.generate(lexicon, strict=False).select("lemma", "paradigm", "text", _shown(F.col("spans")[1]["inflections"]))
    want = [(w, p, w[:-1] + e, ",".join(f)) for w, c in (("書く", "godan_k"), ("食べる", "ichidan")) for p, (e, f) in V.PARADIGMS[c].items()]
    assert rows(told) == known(want)
    assert rows(synth.unsupported(lexicon).select("lemma")) == [("読む",)]
    with pytest.raises(Exception, match="unsupported conjugation: godan_m"):
        synth.generate(lexicon).collect()
    assert synth.generate(lexicon.where("lemma <> '読む'")).count() == 18


def test_scores_of_a_record_with_two_faults(spark):
    rec = C.records(C.compile_records(literals.raw(spark))).withColumn("id", F.col("document_id"))
    flip = F.transform("spans", lambda s: s.withField("inflections", F.when(s["atom_type"] == "AUXILIARY", F.array(F.lit("NEGATIVE"))).otherwise(s["inflections"])).withField("function", F.when(s["function"] == "OBJECT", "TOPIC").otherwise(s["function"])))
    keep = ["id", "text", "boundaries", "spans", "b_spans", "bunsetsu"]
    pairs = score.paired(rec.select(*keep), rec.withColumn("spans", flip).select(*keep), "id")
    f = {r.label: (r.tp, r.fp, r.fn) for r in score.label_scores(pairs, "particle_function").collect()}
    assert f["TOPIC"] == (1, 1, 0) and f["OBJECT"] == (0, 0, 1) and sum(map(sum, f.values())) == 3
    i = {r.label: (r.tp, r.fp, r.fn) for r in score.label_scores(pairs, "inflection").collect()}
    assert i["NEGATIVE"] == (0, 1, 0) and i["PAST"] == (0, 0, 1) and sum(map(sum, i.values())) == 2
