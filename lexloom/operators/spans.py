"""Boundary closure, partitions, trees and surrogate records, as array columns of a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import runs


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def endpoints(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["end"])


def nested_boundaries(predicted: dict[str, Column], n: Column) -> dict[str, Column]:
    """Each level with all endpoints of the coarser ones; endpoints outside 1..n go, n ends a sentence. A length under 1
    is an error."""
    n = F.when(n >= 1, n).otherwise(F.raise_error(F.lit("length must be positive")).cast("int"))
    inside = {k: F.filter(v, lambda x: (x >= 1) & (x <= n)) for k, v in predicted.items()}
    coarse, out = F.array(n.cast("int")), {}
    for level in reversed(V.LEVELS):
        coarse = F.array_union(coarse, inside[level])
        out[level] = F.array_sort(coarse)
    return {level: out[level] for level in V.LEVELS}


def partition(start: Column, end: Column, points: Column) -> Column:
    """Spans (start, end) from start to end, cut at the points between."""
    own = F.filter(sorted_unique(points), lambda x: (x > start) & (x < end))
    cuts = F.concat(own, F.when(end > start, F.array(end)).otherwise(F.array().cast("array<int>")))
    each = lambda cuts: F.transform(cuts, lambda p, i: F.struct(F.when(i == 0, start).otherwise(F.get(cuts, i - 1)).cast("int").alias("start"), p.cast("int").alias("end")))
    return X.let(cuts, each)


def first_missing_level(levels: dict[str, Column]) -> Column:
    """The first coarse level with an endpoint that the next finer one lacks, with those endpoints; null if nested."""
    names = list(levels)
    told = []
    for fine, coarse in zip(names, names[1:], strict=False):
        lacks = sorted_unique(F.array_except(levels[coarse], levels[fine]))
        shown = F.concat(F.lit(f"{coarse} endpoints absent from {fine}: ["), F.array_join(F.transform(lacks, lambda x: x.cast("string")), ", "), F.lit("]"))
        told.append(F.when(F.size(lacks) > 0, shown))
    return F.coalesce(*told)


def argmax_label(logits: Column, labels: list[str] | None = None) -> Column:
    """The label (or index) of the first largest value; null without logits."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    # element_at of labels counts as never null, also where its place is null
    return F.when(at.isNotNull(), F.element_at(F.array(*map(F.lit, labels)), at)) if labels else at - 1


def positive_labels(logits: Column, labels: list[str]) -> Column:
    """Labels of probability one half or more."""
    return F.filter(F.transform(F.array(*map(F.lit, labels)), lambda x, i: F.when(F.get(logits, i) >= 0, x)), lambda x: x.isNotNull())


def softmax_confidence(logits: Column) -> Column:
    """The softmax probability of the largest value."""
    total = lambda most: F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most))
    return 1 / X.let(F.array_max(logits).cast("double"), total)


def inside(spans: Column, parent: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] >= parent["start"]) & (s["end"] <= parent["end"]))


def tree(text: Column, a: Column, b: Column, bunsetsu: Column, clause: Column, sentence: Column) -> Column:
    """Sentences of clauses of bunsetsu of B of A, of array columns of spans. Nodes have their type, the fields of their
    spans, their text and, but for A, children; a bunsetsu has `atoms` too: its A, if it has no B for them."""

    def node(kind: str, s: Column, children: Column | None = None, fields: tuple[str, ...] = (), **more: Column) -> Column:
        own = [F.lit(kind).alias("type"), s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), *(s[f].alias(f) for f in fields)]
        return F.struct(*own, *([children.alias("children")] if children is not None else []), *(c.alias(k) for k, c in more.items()))

    def leaves(s: Column) -> Column:
        return F.transform(inside(a, s), lambda x: node("A", x, fields=("atom_type", "function", "inflections")))

    def chunk(s: Column) -> Column:
        bs = F.transform(inside(b, s), lambda x: node("B", x, leaves(x)))
        return node("BUNSETSU", s, bs, ("role",), atoms=F.filter(leaves(s), lambda _: F.size(bs) == 0))

    return F.transform(sentence, lambda s: node("SENTENCE", s, F.transform(inside(clause, s), lambda c: node("CLAUSE", c, F.transform(inside(bunsetsu, c), chunk)))))


def tree_edges(records: DataFrame, *key: str) -> DataFrame:
    """(key, level, start, end, parent_start, parent_end): each span with the one of the next coarser level around it."""
    own = runs.with_fields(records.select(*key, "text", "boundaries"), _edges, f"edges array<struct<{EDGE}>>", "text", "boundaries")
    return own.select(*key, F.inline("edges"))


EDGE = "level:string,start:int,end:int,parent_start:int,parent_end:int"


def _edges(text: pa.Array, boundaries: pa.Array) -> pa.Array:
    """All edges of each text: a span's parent is the coarser one that holds its start, if it holds its end too."""
    sizes, bounds = runs.sizes_of(text), runs.fields(boundaries)
    cuts = [runs.cut(runs.marks(bounds[level], sizes), sizes) for level in V.LEVELS]
    parts = []
    for level, fine, coarse in zip(V.LEVELS, cuts, cuts[1:], strict=False):
        up = np.searchsorted(coarse.at, fine.at - (fine.end - fine.start - 1))
        start, end = coarse.start[up], coarse.end[up]
        parts.append((fine.row, np.full(len(up), V.LEVELS.index(level)), fine.start, fine.end, start, end, fine.end <= end))
    row, level, start, end, up, to, held = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    edges = runs.struct(
        level=runs.named(V.LEVELS, level[order]), start=runs.whole(start[order]), end=runs.whole(end[order]), parent_start=runs.whole(up[order], held[order]), parent_end=runs.whole(to[order], held[order]),
    )
    return runs.struct(edges=runs.lists(np.bincount(row, minlength=len(sizes)), edges))


def surrogate_atom(kind: Column, p: Column) -> Column:
    """An atom span whose type follows the script of its last character."""
    told = F.when(kind == "LATIN", "NOUN_LIKE").when(kind == "DIGIT", "NUMBER").when(kind.isin("PUNCT", "SYMBOL"), "PUNCT_SYMBOL").otherwise("OTHER")
    return F.struct(p["start"].alias("start"), p["end"].alias("end"), told.alias("atom_type"), F.lit(None).cast("string").alias("function"), F.array().cast("array<string>").alias("inflections"))


def surrogate_role(kind: Column, p: Column) -> Column:
    told = F.when(kind == "PUNCT", "PREDICATE").when(kind == "LATIN", "CASED_NOMINAL").otherwise("UNKNOWN")
    return F.struct(p["start"].alias("start"), p["end"].alias("end"), told.alias("role"))


#: What surrogate_records adds to sentences with the scripts of their characters.
RECORD = (
    "boundaries struct<" + ", ".join(f"{level}:array<int>" for level in V.LEVELS) + ">, spans array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>, "
    "b_spans array<struct<start:int,end:int>>, bunsetsu array<struct<start:int,end:int,role:string>>"
)
_ATOM_OF = {"LATIN": "NOUN_LIKE", "DIGIT": "NUMBER", "PUNCT": "PUNCT_SYMBOL", "SYMBOL": "PUNCT_SYMBOL"}
_ROLE_OF = {"PUNCT": "PREDICATE", "LATIN": "CASED_NOMINAL"}


def _surrogate(scripts: pa.Array) -> pa.Array:
    row, values = runs.elements(scripts)
    sizes = np.bincount(row, minlength=len(scripts))
    script = pc.index_in(values, pa.array(V.SCRIPTS)).to_numpy(zero_copy_only=False)
    space, punct = (script == V.SCRIPTS.index(x) for x in ("WHITESPACE", "PUNCT"))
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    shifted = lambda x, n: np.append(x[n:], np.zeros(n, x.dtype))[: len(x)]
    before = np.append(False, punct[:-1])[: len(row)] & np.append(False, row[1:] == row[:-1])[: len(row)]
    a = last | (shifted(script, 1) != script)
    b = a & (last | ~shifted(space, 1))
    cuts = [runs.cut(x, sizes) for x in (a, b, b & (last | punct | (space & before)), np.zeros(len(row), bool))]
    a, b, chunk, whole = cuts
    told = lambda table, none, at: pa.array([table.get(x, none) for x in V.SCRIPTS]).take(runs.whole(script[at]))
    none = len(a.at)
    spans = a.spans(atom_type=told(_ATOM_OF, "OTHER", a.at), function=pa.nulls(none, pa.string()), inflections=runs.lists(np.zeros(none, np.int64), pa.array([], pa.string())))
    bounds = runs.struct(**{level: x.lists(runs.whole(x.end)) for level, x in zip(V.LEVELS, (*cuts, whole), strict=True)})
    return runs.struct(boundaries=bounds, spans=a.lists(spans), b_spans=b.lists(b.spans()), bunsetsu=chunk.lists(chunk.spans(role=told(_ROLE_OF, "UNKNOWN", chunk.at))))


def surrogate_records(sentences: DataFrame) -> DataFrame:
    """Records (scripts, boundaries, spans, b_spans, bunsetsu) over boundaries that stand in for an analyser's: runs of one
    script, runs with the white space after them, groups that end in punctuation. Labels by the script at the end of a
    span. Nested by construction; not linguistic."""
    s = sentences.withColumn("scripts", F.transform(X.chars(F.col("text")), X.script))
    return runs.with_fields(s, _surrogate, RECORD, "scripts")
