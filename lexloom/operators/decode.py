"""Logits of the sequence model to boundaries, labelled spans and a tree, as array columns of a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import vocabulary as V
from lexloom.operators import infer, runs
from lexloom.sources.weights import Weights

#: Texts that one batch may hold, and code points of a text.
BATCH, MOST_CHARS = 64, 128
INFLECTED = ["VERB_STEM", "AUXILIARY", "COPULA", "ADJECTIVE"]


_ENDS = "a array<int>, b array<int>, bunsetsu array<int>, clause array<int>, sentence array<int>"
_NODE = "type:string,start:int,end:int,text:string"
_LEAF = f"struct<{_NODE},atom_type:string,function:string,inflections:array<string>>"
_CHUNK = f"struct<{_NODE},role:string,children:array<struct<{_NODE},children:array<{_LEAF}>>>,atoms:array<{_LEAF}>>"
_SPAN = "struct<start:int,end:int"
#: What decoded adds to a row.
DECODED = (
    f"levels struct<{_ENDS.replace(' array', ':array')}>, spans array<{_SPAN},atom_type:string,function:string,inflections:array<string>>>, b_spans array<{_SPAN}>>, bunsetsu array<{_SPAN},role:string>>, "
    f"clauses array<{_SPAN}>>, sentences array<{_SPAN}>>, tree array<struct<{_NODE},children:array<struct<{_NODE},children:array<{_CHUNK}>>>>>"
)


def _logits(head: str, column: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits (a row a character) of a head's flat arrays, and which are there."""
    width = V.HEADS[head]
    row, values = runs.elements(column)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(values, -np.inf).to_numpy(zero_copy_only=False)
    of = np.bincount(row, minlength=len(sizes))
    if (of == sizes * width).all():
        return values.reshape(-1, width), known.reshape(-1, width)
    out, there = np.full((int(sizes.sum()), width), -np.inf), np.zeros((int(sizes.sum()), width), bool)
    place = np.arange(len(row)) - (np.cumsum(of) - of)[row]
    own = place < sizes[row] * width
    at = ((np.cumsum(sizes) - sizes)[row] * width + place)[own]
    out.ravel()[at], there.ravel()[at] = values[own], known[own]
    return out, there


def _label(head: str, labels: list[str], logits: dict, at: np.ndarray, none: str) -> np.ndarray:
    """The place of the first largest logit's label at characters; that of `none` without logits."""
    x, known = (v[at] for v in logits[head])
    return np.where(known.any(1), x.argmax(1), labels.index(none)) if len(at) else np.zeros(0, np.int64)


def _decoded(text: pa.Array, *heads: pa.Array) -> pa.Array:
    sizes = runs.sizes_of(text)
    if (sizes < 1).any():
        raise ValueError("length must be positive")
    return runs.struct(**_read(text, {head: _logits(head, column, sizes) for head, column in zip(V.HEADS, heads, strict=True)}, sizes))


def _read(text: pa.Array, logits: dict[str, tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, tree: bool = True) -> dict[str, pa.Array]:
    """The columns of DECODED. Levels close upwards, so spans of a level are runs of those of the next finer one, and a
    tree is its spans with numbers of children."""
    x, known = logits["boundaries"]
    # nan is larger than any number in Spark
    ends = np.maximum.accumulate((known & ~(x < 0))[:, ::-1], axis=1)[:, ::-1]
    a, b, chunk, clause, sentence = (runs.cut(ends[:, k], sizes) for k in range(len(V.LEVELS)))
    levels = {level: c.lists(runs.whole(c.end)) for level, c in zip(V.LEVELS, (a, b, chunk, clause, sentence), strict=True)}
    kind = _label("atom", V.ATOM_TYPES, logits, a.at, "OTHER")
    function = _label("function", V.PARTICLE_FUNCTIONS, logits, a.at, "UNKNOWN")
    particle = (kind == V.ATOM_TYPES.index("PARTICLE")) & logits["function"][1][a.at].any(1)
    x, known = logits["inflection"]
    flags = known[a.at] & ~(x[a.at] < 0) & np.isin(kind, [V.ATOM_TYPES.index(k) for k in INFLECTED])[:, None]
    atoms = {"atom_type": runs.named(V.ATOM_TYPES, kind), "function": runs.named(V.PARTICLE_FUNCTIONS, function, particle), "inflections": runs.flagged(V.INFLECTIONS, flags)}
    role = {"role": runs.named(V.BUNSETSU_ROLES, _label("role", V.BUNSETSU_ROLES, logits, chunk.at, "UNKNOWN"))}

    flat = {
        "levels": runs.struct(**levels), "spans": a.lists(a.spans(**atoms)), "b_spans": b.lists(b.spans()), "bunsetsu": chunk.lists(chunk.spans(**role)), "clauses": clause.lists(clause.spans()),
        "sentences": sentence.lists(sentence.spans()),
    }
    if not tree:
        return flat
    texts = text.to_pylist()

    def node(kind: str, own: runs.Cut, **more: pa.Array) -> pa.Array:
        return runs.struct(type=pa.array([kind] * len(own.at), pa.string()), start=runs.whole(own.start), end=runs.whole(own.end), text=own.texts(texts), **more)

    leaves = node("A", a, **atoms)
    nodes = node("B", b, children=runs.lists(a.inside(b), leaves))
    # every chunk has spans of b, so none holds atoms of its own
    none = runs.lists(np.zeros(len(chunk.at), np.int64), leaves[:0])
    nodes = node("BUNSETSU", chunk, **role, children=runs.lists(b.inside(chunk), nodes), atoms=none)
    nodes = node("CLAUSE", clause, children=runs.lists(chunk.inside(clause), nodes))
    nodes = node("SENTENCE", sentence, children=runs.lists(clause.inside(sentence), nodes))
    return flat | {"tree": sentence.lists(nodes)}


def decoded(rows: DataFrame, make: Callable | None = None) -> DataFrame:
    """rows (text and a flat array of logits a head, null where a head is not there) with what the logits say. With make,
    which gives structs of logits by head of texts, these are read where they are made, and pass not through Spark.

    levels (nested endpoints), spans (A with atom_type, function of particles, inflections of inflected types), b_spans,
    bunsetsu (with role), clauses, sentences, tree (sentences of clauses of bunsetsu of B of A) and root: SENTENCE if
    there is one sentence, else DOCUMENT. Without a head labels are OTHER, null, none and UNKNOWN. Arrow batches are
    decoded as a whole, for array functions of Spark copy a text's logits for each span.
    """
    if make:
        out = runs.with_fields(rows, lambda text: _decoded(text, *map(runs.fields(make(text)).get, V.HEADS)), DECODED, "text")
    else:
        out = runs.with_fields(rows, _decoded, DECODED, "text", *[F.col(head).cast("array<double>") for head in V.HEADS])
    return out.withColumn("root", F.when(F.size("sentences") == 1, "SENTENCE").otherwise("DOCUMENT"))


def rejected(texts: DataFrame, most: int = MOST_CHARS) -> Column:
    """Why a text cannot be analysed, or null."""
    n = F.length("text")
    return F.when(n.isNull() | (n == 0), "text must be non-empty").when(n > most, F.concat(F.lit(f"text exceeds {most} code points: "), n.cast("string")))


def analyze(texts: DataFrame, weights: Weights, key: str, equal: bool = True, only: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of texts (key, text): what the model says of each, and the rows it rejects with a reason.

    Texts of one length make batches of up to 64, without padding; or else (equal false) texts of any length do, padded
    and masked. With `only`, the named columns of DECODED alone, read where the logits are made, which then are not told.
    """
    told = texts.select(key, "text", rejected(texts).alias("reason"))
    bad = told.where("reason is not null")
    good = told.where("reason is null").select(key, "text")
    if only is None:
        return decoded(infer.predict_texts(good, weights, key, BATCH, equal).drop("n")), bad

    def make(text: pa.Array, logits: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, pa.Array]:
        there = {head: (x, np.ones(x.shape, bool)) for head, x in logits.items()}
        found = _read(text, there, sizes, "tree" in only)
        return {c: found[c] for c in only}

    kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(DECODED)}
    return infer.predict_texts(good, weights, key, BATCH, equal, make, ", ".join(f"{c} {kinds[c]}" for c in only)), bad


def equal_length_batch(texts: list[str], most: int = MOST_CHARS) -> int:
    """The length of the texts of one batch; an error if they are none, too many, empty, too long or of unequal length."""
    if not 1 <= len(texts) <= BATCH:
        raise ValueError(f"a batch holds 1 to {BATCH} texts")
    sizes = {len(t) for t in texts}
    if len(sizes) > 1:
        raise ValueError("texts of a batch have one length")
    (n,) = sizes
    if not 1 <= n <= most:
        raise ValueError(f"texts of a batch have 1 to {most} code points")
    return n
