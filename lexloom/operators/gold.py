"""Gold corpora to records: CoNLL-U and KNP sentences, parsed by lexloom.sources.readers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import labels as L
from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import runs, validate
from lexloom.operators.spans import endpoints
from lexloom.operators.validate import violations

_FLAGS = "array<string>"


def _starts(lengths: Column) -> Column:
    """Start of each token: the sum of the lengths before it (sentences are short, so sums are taken anew)."""
    return F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, flag) for c, flag in pairs]))))


def _groups(starts: Column, n: Column) -> Column:
    """(first, after) token numbers of groups that begin at the starts; one group if there are none."""
    own = F.when(F.size(starts) > 0, F.array_sort(F.array_distinct(starts))).otherwise(F.array(F.lit(0)))
    return F.transform(own, lambda s, i: F.struct(s.cast("int").alias("i"), F.coalesce(F.get(own, i + 1), n).cast("int").alias("j")))


def _finished(df: DataFrame, source: Column, document: Column) -> DataFrame:
    """Records with their violations; df has text, spans, b_spans, bunsetsu, covers and what `document` needs."""
    n = F.array(F.length("text"))
    bounds = F.struct(endpoints(F.col("spans")).alias("a"), endpoints(F.col("b_spans")).alias("b"), endpoints(F.col("bunsetsu")).alias("bunsetsu"), n.alias("clause"), n.alias("sentence"))
    out = X.computed(df, boundaries=bounds)
    codes = F.when(~F.col("covers"), F.array(F.lit("tokens_do_not_cover_text"))).otherwise(violations(F.col("text"), F.col("boundaries"), F.col("spans"), F.col("b_spans"), F.col("bunsetsu")))
    return out.select(F.lit(V.SCHEMA_VERSION).alias("schema_version"), "text", source.alias("source"), document.alias("document_id"), "sentence_id", "boundaries", "spans", "b_spans", "bunsetsu", codes.alias("errors"))


def ud_records(sentences: DataFrame, source: str = "ud-ja-gsd") -> DataFrame:
    """sentences (comments map, tokens: arrays of ten fields) to records with errors."""
    f = lambda t, i: F.get(t, F.lit(i))
    has = lambda c, x: F.instr(c, x) > 0
    text = F.coalesce(F.when(F.try_element_at("comments", F.lit("text")) != "", F.try_element_at("comments", F.lit("text"))), F.array_join(F.transform("tokens", lambda t: f(t, 1)), ""))
    df = sentences.withColumn("text", text).withColumn("_len", F.transform("tokens", lambda t: F.length(f(t, 1)))).withColumn("_start", _starts(F.col("_len")))
    df = df.withColumn("covers", F.array_join(F.transform("tokens", lambda t: f(t, 1)), "") == F.col("text")).withColumn("_n", F.size("tokens"))
    atom = lambda t: F.when((f(t, 3) == "AUX") & has(f(t, 4), "助動詞-ダ"), "COPULA").otherwise(F.coalesce(L.look_up(V.UPOS_ATOM, f(t, 3)), F.lit("OTHER")))
    flags = lambda t: _flags(
        (has(f(t, 5), "Tense=Past") | has(f(t, 4), "助動詞-タ"), "PAST"), (has(f(t, 5), "Polarity=Neg") | has(f(t, 4), "助動詞-ナイ") | has(f(t, 4), "助動詞-ヌ"), "NEGATIVE"), (has(f(t, 4), "助動詞-マス"), "POLITE")
    )

    def span(t: Column, i: Column) -> Column:
        start = F.get("_start", i)
        function = F.when(atom(t) == "PARTICLE", F.coalesce(L.look_up(V.UD_FUNCTION, f(t, 1)), F.lit("UNKNOWN")))
        return F.struct(start.alias("start"), (start + F.get("_len", i)).alias("end"), atom(t).alias("atom_type"), function.alias("function"), flags(t).cast(_FLAGS).alias("inflections"))

    df = X.computed(df, spans=F.transform("tokens", span))
    marked = lambda label: F.filter(F.transform("tokens", lambda t, i: F.when(F.array_contains(F.split(f(t, 9), r"\|"), f"{label}=B"), i)), lambda i: i.isNotNull())
    cut = lambda g, make: F.transform(g, lambda x: make(F.get("spans", x["i"])["start"], F.get("spans", x["j"] - 1)["end"], F.slice("tokens", x["i"] + 1, x["j"] - x["i"])))
    df = X.computed(df, b_spans=cut(_groups(marked("LUWBILabel"), F.col("_n")), lambda a, b, _: F.struct(a.alias("start"), b.alias("end"))))

    def chunk(a: Column, b: Column, own: Column) -> Column:
        head = F.coalesce(F.get(F.filter(own, lambda t: F.lower(f(t, 7)) == "root"), F.lit(0)), F.get(own, F.lit(0)))
        topic = F.exists(own, lambda t: f(t, 1).isin("は", "も"))
        return F.struct(a.alias("start"), b.alias("end"), L.bunsetsu_role(f(head, 7), F.when(topic, "TOPIC"), f(head, 3).isin("VERB", "ADJ")).alias("role"))

    df = X.computed(df, bunsetsu=cut(_groups(marked("BunsetuBILabel"), F.col("_n")), chunk)).withColumn("sentence_id", F.try_element_at("comments", F.lit("sent_id")))
    return _finished(df, F.lit(source), F.coalesce(F.try_element_at("comments", F.lit("newdoc id")), "sentence_id", F.lit("")))


#: What is found of the tokens of KNP sentences.
KNP = (
    "text string, boundaries struct<" + ", ".join(f"{level}:array<int>" for level in V.LEVELS) + ">, spans array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>, "
    "b_spans array<struct<start:int,end:int>>, bunsetsu array<struct<start:int,end:int,role:string>>, errors array<string>"
)


def _cut_at(starts: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each group of tokens, its first token and the one after its last, in the row; one group without starts."""
    row, at = runs.elements(starts)
    none = np.flatnonzero(np.bincount(row, minlength=len(count)) == 0)
    both = np.unique(np.stack([np.append(row, none), np.append(runs.ints(at, 0), 0 * none)]), axis=1)
    row, first = both
    after = np.where(np.append(row[1:] == row[:-1], False)[: len(row)], np.append(first[1:], 0)[: len(row)], count[row])
    return row, first, after


def _knp(tokens: pa.Array, b_starts: pa.Array, bunsetsu_starts: pa.Array) -> pa.Array:
    row, own = runs.elements(tokens)
    own, rows = runs.fields(own), len(tokens)
    count = np.bincount(row, minlength=rows)
    before = np.cumsum(count) - count
    size = runs.sizes_of(own["surface"])
    end = np.cumsum(size)
    end = end - np.append(0, end)[before][row]
    start = end - size
    text = pc.binary_join(runs.lists(count, own["surface"]), "")
    is_ = lambda c, *names: pc.fill_null(pc.is_in(own[c], pa.array(names)), False).to_numpy(zero_copy_only=False)
    has = lambda x: pc.fill_null(pc.match_substring(own["conj_form"], x), False).to_numpy(zero_copy_only=False)
    flags = {
        "CAUSATIVE": is_("lemma", "せる", "させる"), "CONDITIONAL": has("条件") | has("仮定"), "NEGATIVE": is_("lemma", "ない", "ぬ", "ず"), "PASSIVE": is_("lemma", "れる", "られる"), "PAST": is_("lemma", "た", "だ") | has("タ形"),
        "POLITE": is_("lemma", "ます"),
    }
    particle = is_("pos", "助詞")
    function = pc.if_else(pa.array(particle), pc.coalesce(runs.look_up(V.KNP_FUNCTION, own["surface"]), pa.scalar("UNKNOWN")), pa.scalar(None, pa.string()))
    atom = pc.coalesce(runs.look_up(V.KNP_ATOM, own["pos"]), pa.scalar("OTHER"))
    spans = runs.lists(count, runs.struct(start=runs.whole(start), end=runs.whole(end), atom_type=atom, function=function, inflections=runs.flagged([*flags], np.stack([*flags.values()], 1))))

    def groups(starts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, first, after = _cut_at(starts, count)
        return of, first + before[of], after + before[of]

    def cut(of: np.ndarray, first: np.ndarray, after: np.ndarray, **more: pa.Array) -> pa.Array:
        # a group after all tokens has no start
        there = first < before[of] + count[of]
        return runs.lists(np.bincount(of, minlength=rows), runs.struct(start=runs.whole(np.append(start, 0)[np.where(there, first, 0)], there), end=runs.whole(end[after - 1]), **more))

    b, (of, first, after) = groups(b_starts), groups(bunsetsu_starts)
    held = lambda x: np.diff(np.append(0, np.cumsum(x))[np.stack([first, after])], axis=0)[0]
    verb, noun = is_("pos", "動詞", "形容詞", "判定詞"), is_("pos", "名詞", "指示詞")
    role = np.select([held(is_("surface", "は")) > 0, held(verb) > 0, held(is_("pos", "特殊")) == after - first, (held(noun) > 0) & (held(particle) > 0)], [V.BUNSETSU_ROLES.index(x) for x in ("TOPIC", "PREDICATE", "PUNCT", "CASED_NOMINAL")], V.BUNSETSU_ROLES.index("UNKNOWN"))
    b_spans, bunsetsu = cut(*b), cut(of, first, after, role=runs.named(V.BUNSETSU_ROLES, role))
    ends = lambda x: runs.lists(pc.list_value_length(x).to_numpy(zero_copy_only=False), x.flatten().field("end"))
    whole = runs.lists(np.ones(rows, np.int64), runs.whole(runs.sizes_of(text)))
    bounds = runs.struct(a=ends(spans), b=ends(b_spans), bunsetsu=ends(bunsetsu), clause=whole, sentence=whole)
    return runs.struct(text=text, boundaries=bounds, spans=spans, b_spans=b_spans, bunsetsu=bunsetsu, errors=validate.codes(text, bounds, spans, b_spans, bunsetsu))


def knp_records(sentences: DataFrame) -> DataFrame:
    """sentences (sentence_id, document_id, tokens, b_starts, bunsetsu_starts) to records with errors, made of whole Arrow
    batches."""
    out = runs.with_fields(sentences.select("sentence_id", "document_id", "tokens", "b_starts", "bunsetsu_starts"), _knp, KNP, "tokens", "b_starts", "bunsetsu_starts")
    return out.select(F.lit(V.SCHEMA_VERSION).alias("schema_version"), "text", F.lit("kwdlc").alias("source"), "document_id", "sentence_id", "boundaries", "spans", "b_spans", "bunsetsu", "errors")
