"""Small inline inputs: Japanese morphology that the tables do not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import compile as C

TEXT = "昨日は映画を見た。"


def _token(surface, pos=None, normalized=None, start=None, end=None):
    return {"surface": surface, "start": start, "end": end, "pos": pos, "normalized_form": normalized, "inflection_form": None, "context": None}


def _chunk(surface, dependency=None, predicate=None, function=None):
    return {"surface": surface, "start": None, "end": None, "dependency": dependency, "is_predicate": predicate, "particle_function": function}


A = [
    _token("昨日", ["名詞", "普通名詞"]), _token("は", ["助詞", "係助詞"]), _token("映画", ["名詞", "普通名詞"]), _token("を", ["助詞", "格助詞"]), _token("見", ["動詞", "一般"]),
    _token("た", ["助動詞", "*"], "た"), _token("。", ["補助記号", "句点"]),
]
B = [_token(x) for x in ("昨日", "は", "映画", "を", "見た", "。")]
G = [_chunk("昨日は", "nsubj", None, "TOPIC"), _chunk("映画を", "obj"), _chunk("見た", "root", True), _chunk("。", "punct")]


def raw(spark: SparkSession) -> DataFrame:
    base = {"text": TEXT, "source": "unit", "sudachi_a": A, "sudachi_b": B, "ginza_bunsetsu": G, "clause_boundaries": None, "alignment_adjustments": None, "teacher_versions": None}
    rows = [
        base | {"document_id": "good"},
        base | {"document_id": "one_b", "sudachi_b": [_token(TEXT)]},
        base | {"document_id": "short", "text": "短い。"},
        base | {"document_id": "long", "text": "長" * 129},
        base | {"document_id": "no_b", "sudachi_b": None},
        base | {"document_id": "gap", "sudachi_a": [A[0], A[2]]},
        base | {"document_id": "cut", "sudachi_a": A[:-1]},
        base | {"document_id": "clause", "clause_boundaries": [4, 9]},
        base | {"document_id": "beyond", "sudachi_a": [_token("昨日", ["名詞"], None, 0, 3), *A[1:]]},
    ]
    return spark.createDataFrame([[r[c] for c in ("text", "source", "document_id", "sudachi_a", "sudachi_b", "ginza_bunsetsu", "clause_boundaries", "alignment_adjustments", "teacher_versions")] for r in rows], C.RAW)


def alignments(spark: SparkSession) -> DataFrame:
    t = lambda s, a=None, b=None: {"surface": s, "start": a, "end": b}
    text = "映画を見た。"
    rows = [
        ("exact", text, [t("映画"), t("を"), t("見"), t("た"), t("。")]), ("skips", text, [t("映画"), t("見た")]), ("empty", text, [t("映画"), t("")]), ("half", text, [t("映画", 0, None)]),
        ("back", text, [t("映画", 0, 2), t("を", 1, 3)]), ("other", text, [t("映面", 0, 2)]), ("short", text, [t("映画"), t("を")]), ("none", text, []),
    ]
    return spark.createDataFrame(rows, "id string, text string, tokens array<struct<surface:string,start:int,end:int>>")


def labels(spark: SparkSession) -> DataFrame:
    n = None
    rows = [
        ("proper", "東京", ["名詞", "固有名詞"], n, "", "", "nsubj", False), ("number", "三", ["名詞", "数詞"], n, "", "", "nmod", False), ("verb", "見", ["動詞", "一般"], n, "", "", "root", True),
        ("copula", "だ", ["助動詞", "*", "*", "*", "助動詞-ダ", "終止形-一般"], n, "だ", "", "aux", False), ("ni", "に", ["助詞", "格助詞"], n, "", "", "case", False), ("ni_time", "に", ["助詞", "格助詞"], "TIME", "", "", "obl", False),
        ("to_quote", "と", ["助詞", "格助詞"], "QUOTE", "", "", "advcl", False), ("to", "と", ["助詞", "格助詞"], n, "", "", "CC", False), ("o", "を", ["助詞", "格助詞"], n, "", "", "obj", False),
        ("wa", "は", ["助詞", "係助詞"], n, "", "", "nsubj", False), ("yo", "よ", ["助詞", "終助詞"], n, "", "", "mark", False), ("nakatta", "なかっ", ["助動詞"], n, "ない", "", "aux", False),
        ("ta", "た", ["助動詞"], n, "た", "", "aux", False), ("nakere", "なけれ", ["助動詞"], n, "ない", "仮定形-一般", "aux", False), ("masen", "ませんでした", ["助動詞"], n, "", "", "aux", False), ("none", "x", [], n, "", "", "", False),
    ]
    return spark.createDataFrame(rows, "id string, surface string, pos array<string>, case string, normalized string, form string, dependency string, predicate boolean")


def records(spark: SparkSession) -> DataFrame:
    """Valid and broken records over a text of four characters."""
    a = lambda s, e, t="NOUN_LIKE", f=None, i=(): (s, e, t, f, list(i))
    good = {"a": [2, 4], "b": [2, 4], "bunsetsu": [4], "clause": [4], "sentence": [4]}
    spans, b, c = [a(0, 2), a(2, 4)], [(0, 2), (2, 4)], [(0, 4, "PREDICATE")]
    row = lambda id_, text="映画見た", bounds=good, s=spans, bs=b, ch=c: (id_, text, bounds and tuple(bounds[k] for k in ("a", "b", "bunsetsu", "clause", "sentence")), s, bs, ch)
    rows = [
        row("valid"), row("empty", text=""), row("no_boundaries", bounds=None), row("unsorted", bounds=good | {"a": [4, 2]}), row("far", bounds=good | {"a": [2, 4, 5]}), row("hole", bounds=good | {"b": [1, 2, 4]}, bs=[(0, 1), (1, 2), (2, 4)]),
        row("gap", s=[a(0, 1), a(2, 4)]), row("beyond", s=[a(0, 2), a(2, 5)]), row("bad_atom", s=[a(0, 2, "NOUN"), a(2, 4)]), row("bad_function", s=[a(0, 2, "PARTICLE", "WHO"), a(2, 4)]),
        row("bad_inflection", s=[a(0, 2), a(2, 4, "VERB_STEM", None, ["WAS"])]), row("bad_role", ch=[(0, 4, "VERB")]), row("no_spans", s=None), row("no_bunsetsu", ch=None), row("null_level", bounds=good | {"b": None}), row("no_cover", s=[a(0, 2)]),
    ]
    bounds = "struct<a:array<int>,b:array<int>,bunsetsu:array<int>,clause:array<int>,sentence:array<int>>"
    span = "array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>"
    return spark.createDataFrame(rows, f"id string, text string, boundaries {bounds}, spans {span}, b_spans array<struct<start:int,end:int>>, bunsetsu array<struct<start:int,end:int,role:string>>")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("書く", "godan_k"), ("食べる", "ichidan"), ("読む", "godan_m")], "lemma string, conjugation string")


CONLLU = [
    "# sent_id = x", "# text = 映画を見た。", "1\t映画\t映画\tNOUN\t名詞-普通名詞-一般\t_\t3\tobj\t_\tBunsetuBILabel=B|LUWBILabel=B|SpaceAfter=No",
    "2\tを\tを\tADP\t助詞-格助詞\t_\t1\tcase\t_\tBunsetuBILabel=I|LUWBILabel=B|SpaceAfter=No", "2-3\tを見\t_\t_\t_\t_\t_\t_\t_\t_",
    "3\t見\t見る\tVERB\t動詞-一般\t_\t0\troot\t_\tBunsetuBILabel=B|LUWBILabel=B|SpaceAfter=No", "4\tた\tた\tAUX\t助動詞-助動詞-タ\tTense=Past\t3\taux\t_\tBunsetuBILabel=I|LUWBILabel=B|SpaceAfter=No",
    "5\t。\t。\tPUNCT\t補助記号-句点\t_\t3\tpunct\t_\tBunsetuBILabel=I|LUWBILabel=B",
]
KNP = [
    "# S-ID:d-1", "* 1D", "+ 1D", "映画 えいが 映画 名詞 6 普通名詞 1 * 0 * 0 NIL", "を を を 助詞 9 格助詞 1 * 0 * 0 NIL", "* -1D", "+ -1D", "見た みた 見る 動詞 2 * 0 母音動詞 1 タ形 10 NIL",
    "。 。 。 特殊 1 句点 1 * 0 * 0 NIL",
]


def conllu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("\n".join(CONLLU),)], "value string")


def knp(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("\n".join(KNP) + "\n",)], "value string").select("value", F.lit("d").alias("document_id"))
