"""Analysers as systems: predictions of token and chunk analysers alone and together, scored on the rows all handle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import compile as C
from lexloom.operators import runs, score
from lexloom.operators.align import aligned
from lexloom.operators.spans import RECORD

#: What a token analyser makes of a text (fine and coarse tokens), and a chunk analyser.
TOKENS = f"a array<{C.TOKEN}>, b array<{C.TOKEN}>"
CHUNKS = "chunks array<struct<start:int,end:int,dependency:string,topic:boolean,is_predicate:boolean>>"
#: The metrics and labels that a system answers for; of metrics without labels, all.
TOKEN_SCOPE = {"boundaries": ["a", "b"], "atom": None, "inflection": None, "particle_function": None}
CHUNK_SCOPE = {"boundaries": ["bunsetsu"], "bunsetsu_role": None}
SCOPES = {"tokens": TOKEN_SCOPE, "chunks": CHUNK_SCOPE}


#: What is found of a row: why it has no record, or a record.
FOUND = f"error string, {RECORD}"
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])


def _solid(tokens: pa.Array) -> pa.Array:
    """Lists of tokens without those that are empty and of no width."""
    row, values = runs.elements(tokens)
    own = runs.fields(values)
    flat = pc.and_(pc.equal(pc.fill_null(own["surface"], "").cast(pa.string()), ""), pc.fill_null(pc.equal(own["start"], own["end"]), False))
    keep = ~flat.to_numpy(zero_copy_only=False)
    if keep.all():
        return tokens
    there = runs.known(tokens)
    return runs.some_lists(there, np.bincount(row[keep], minlength=len(tokens))[there], values.filter(pa.array(keep)))


def _one(values: pa.Array) -> pa.Array:
    """A list of one value for each row."""
    return runs.lists(np.ones(len(values), np.int64), values)


def _field(lists: pa.Array, name: str) -> pa.Array:
    """Lists of a field of the structs of lists."""
    there = runs.known(lists)
    return runs.some_lists(there, pc.list_value_length(lists).to_numpy(zero_copy_only=False)[there].astype(np.int64), runs.fields(lists.flatten())[name])


def _ends_of_text(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The length of each text, null of null, and where it starts."""
    return runs.whole(runs.sizes_of(text), runs.known(text)), runs.whole(np.zeros(len(text), np.int64))


def token_records(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """What token_predictions tells, of an Arrow batch: FOUND."""
    sides, why = [_solid(x) for x in (a, b)], np.full(len(text), None, object)
    why[~(runs.known(a) & runs.known(b))] = "no tokens"
    spans = []
    for own, name in zip(sides, "ab", strict=True):
        told = aligned(text, own, name, False)
        for r in np.flatnonzero(runs.known(told["reason"]) & np.equal(why, None)).tolist():
            why[r] = " ".join(x for x in (name, told["reason"][r].as_py(), told["detail"][r].as_py()) if x is not None)
        spans.append(told["spans"])
    good = runs.known(spans[0])
    tokens = sides[0].filter(pa.array(good)).flatten()
    sizes = pc.list_value_length(spans[0]).to_numpy(zero_copy_only=False)[good].astype(np.int64)
    atoms = runs.some_lists(good, sizes, runs.struct(**runs.fields(spans[0].flatten()), **C.atoms_of(runs.fields(tokens))))
    n, zero = _ends_of_text(text)
    whole = _one(n)
    bounds = runs.struct(a=_field(spans[0], "end"), b=_field(spans[1], "end"), bunsetsu=whole, clause=whole, sentence=whole)
    chunk = runs.struct(start=zero, end=n, role=pa.array(np.full(len(text), "UNKNOWN")))
    return runs.struct(error=pa.array(why, pa.string()), boundaries=bounds, spans=atoms, b_spans=spans[1], bunsetsu=_one(chunk))


def chunk_records(text: pa.Array, chunks: pa.Array, to_next: bool = True) -> pa.Array:
    """What chunk_predictions tells, of an Arrow batch: FOUND."""
    rows, n, (row, own) = len(text), runs.sizes_of(text), runs.elements(chunks)
    own = runs.fields(own)
    start, end = (runs.ints(own[x], 0) for x in ("start", "end"))
    begun, ended = runs.known(own["start"]), runs.known(own["end"])
    count = np.bincount(row, minlength=rows)
    first, last = (np.ones(len(row), bool) for _ in range(2))
    first[1:] = row[1:] != row[:-1]
    last[:-1] = first[1:]
    # characters that are no white space, before each
    base = np.cumsum(n) - n
    solid = np.append(0, np.cumsum(~_SPACE[np.minimum(runs.points_of(text), len(_SPACE) - 1)]))
    until = lambda at, of: solid[base[of] + np.clip(at, 0, n[of])]
    before = np.where(first, 0, np.append(0, end[:-1])[: len(row)])
    held = first | np.append(True, ended[:-1])[: len(row)]
    wrong = (held & begun & ((start < before) | (until(start, row) > until(before, row)))) | (begun & ended & (end < start)) | (ended & (end > n[row]) & runs.known(text)[row])
    why = np.full(rows, None, object)
    some = np.flatnonzero(last & ended)
    tail = some[solid[(base + n)[row[some]]] > until(end[some], row[some])]
    # of several faults the first counts, the tail only without others
    for at, where in ((tail, end), (np.flatnonzero(wrong)[::-1], before)):
        for r, x in zip(row[at].tolist(), where[at].tolist(), strict=True):
            why[r] = f"text not covered at {x}"
    why[count == 0] = "no chunks"
    ends, (length, zero) = np.where(last, n[row], end if to_next else np.append(start[1:], 0)[: len(row)]), _ends_of_text(text)
    to = np.where(last, runs.known(text)[row], ended if to_next else np.append(begun[1:], False)[: len(row)])
    begin = np.where(first, 0, before if to_next else start)
    role = C.roles_of(pc.fill_null(own["dependency"], ""), runs.named(["TOPIC"], np.zeros(len(row), np.int64), pc.fill_null(own["topic"], False).to_numpy(zero_copy_only=False)), own["is_predicate"])
    wide = runs.struct(start=runs.whole(begin, first | (held if to_next else begun)), end=runs.whole(ends, to), role=role)
    whole = _one(length)
    atom = runs.struct(start=zero, end=length, atom_type=pa.array(np.full(rows, "OTHER")), function=pa.nulls(rows, pa.string()), inflections=runs.lists(np.zeros(rows, np.int64), pa.array([], pa.string())))
    bounds = runs.struct(a=whole, b=whole, bunsetsu=runs.lists(count, wide.field("end")), clause=whole, sentence=whole)
    return runs.struct(error=pa.array(why, pa.string()), boundaries=bounds, spans=_one(atom), b_spans=_one(runs.struct(start=zero, end=length)), bunsetsu=runs.lists(count, wide))


def recorded(text: pa.Array, found: pa.Array) -> pa.Array:
    """Records with their texts, null where there is an error."""
    own = runs.fields(found)
    bad = runs.known(own.pop("error")) if "error" in own else np.zeros(len(text), bool)
    own = {"text": text} | own
    return pa.StructArray.from_arrays(list(own.values()), names=list(own), mask=pa.array(bad))


def _told(rows: DataFrame, key: str, found: Callable, *inputs: str) -> tuple[DataFrame, DataFrame]:
    out = runs.with_fields(rows.select(key, *inputs), found, FOUND, *inputs)
    return out.where("error is null").select(key, "text", "boundaries", "spans", "b_spans", "bunsetsu"), out.where("error is not null").select(key, "text", "error")


def token_predictions(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records of rows (key, text, a, b: tokens), and the rows (key, text, error) whose tokens do not tile the text.

    Empty tokens of no width are skipped. A record has the tokens' boundaries and labels; chunks, clauses and sentences
    are the whole text.
    """
    return _told(rows, key, token_records, "text", "a", "b")


def chunk_predictions(rows: DataFrame, key: str, to_next: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of rows (key, text, chunks ascending), and the rows (key, text, error) whose chunks leave out more than
    white space, overlap, or are none.

    White space between chunks joins the chunk after it (the last takes what follows it), or else the one before it (the
    first takes what is before it). Tokens are the whole text.
    """

    def found(text: pa.Array, chunks: pa.Array) -> pa.Array:
        return chunk_records(text, chunks, to_next)

    return _told(rows, key, found, "text", "chunks")


def _in_scope(scope: dict[str, list[str] | None]) -> Column:
    own = [F.col("metric").eqNullSafe(m) if labels is None else (F.col("metric") == m) & F.col("label").isin(labels) for m, labels in scope.items()]
    return reduce(lambda a, b: a | b, own)


def scoped(scores: DataFrame, scope: dict[str, list[str] | None]) -> DataFrame:
    """The rows of score.score_corpus that a system answers for."""
    return scores.where(_in_scope(scope))


def _equal(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Which rows are equal; nulls are equal to each other. Parts are compared of rows alike so far."""
    same = runs.known(x) == runs.known(y)
    if pa.types.is_list(x.type):
        size, other = (pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False) for v in (x, y))
        same &= size == other
        at = np.flatnonzero(same)
        x, y = (v.take(pa.array(at)).flatten() for v in (x, y))
        unlike = np.repeat(at, size[at])[~_equal(x, y)] if len(x) else at[:0]
        same[unlike] = False
    elif pa.types.is_struct(x.type):
        for name in [f.name for f in x.type]:
            at = np.flatnonzero(same)
            same[at[~_equal(*[runs.fields(v.take(pa.array(at)))[name] for v in (x, y)])]] = False
    else:
        same &= pc.fill_null(pc.equal(x, y.cast(x.type)), True).to_numpy(zero_copy_only=False)
    return same


def _columns(gold: dict[str, pa.Array], pred: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """What score.counted reads, of records (fields text and those of RECORD)."""
    out = {"n": pa.array(np.minimum(runs.sizes_of(gold["text"]), runs.sizes_of(pred["text"])))}
    for side, own in (("gold", gold), ("pred", pred)):
        out |= {f"{side}_ends_{level}": x for level, x in runs.fields(own["boundaries"]).items()} | {f"{side}_{c}": own[c] for c in ("spans", "bunsetsu")}
    return out


def _combined(tokens: dict[str, pa.Array], chunks: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """As score.combined_prediction combines records."""
    fine, coarse = (runs.fields(x["boundaries"]) for x in (tokens, chunks))
    return tokens | {"boundaries": runs.struct(a=fine["a"], b=fine["b"], **{k: coarse[k] for k in ("bunsetsu", "clause", "sentence")}), "bunsetsu": chunks["bunsetsu"]}


def _batch_counts(records: dict[str, pa.Array]) -> dict[str, dict[str, np.ndarray]]:
    """By system and metric (tp, fp, fn) of each label, of the rows of a batch that gold and all systems have."""
    there = np.logical_and.reduce([runs.known(x) for x in records.values()])
    gold, systems = None, {}
    for name, x in records.items():
        own = runs.fields(x if there.all() else x.filter(pa.array(there)))
        if name == "gold":
            gold = own
        else:
            systems[name] = own
    if not there.any():
        return {}
    told = {}
    for name, own in systems.items():
        scope = SCOPES.get(name, dict.fromkeys(score.LABELS))
        same = {} if name in SCOPES else {"same": _same(gold, own)}
        told[name] = score.counted(_columns(gold, own) | same, scope, scope["boundaries"] or V.LEVELS)
    # a combined record has its tokens' labels and its chunks' roles: these are counted already, if texts are of one length
    tokens, chunks = systems["tokens"], systems["chunks"]
    both = _combined(tokens, chunks)
    alike = np.array_equal(runs.sizes_of(tokens["text"]), runs.sizes_of(chunks["text"]))
    held = {m: told["tokens"][m] for m in ("atom", "inflection", "particle_function")} | ({"bunsetsu_role": told["chunks"]["bunsetsu_role"]} if alike else {})
    told["combined"] = held | score.counted(_columns(gold, both) | {"same": _same(gold, both)}, [m for m in score.LABELS if m not in held])
    return told


def _same(gold: dict[str, pa.Array], pred: dict[str, pa.Array]) -> pa.Array:
    """Which records have the same trees."""
    at = np.arange(len(gold["text"]))
    for c in ("boundaries", "spans", "b_spans", "bunsetsu"):
        at = at[_equal(*[x[c].take(pa.array(at)) for x in (gold, pred)])]
    return pa.array(np.isin(np.arange(len(gold["text"])), at))


def compared_batches(rows: DataFrame, records: Callable[[pa.RecordBatch], dict[str, pa.Array]], *more: str) -> DataFrame:
    """What compared tells of rows, of which records(batch) makes the structs (text, and fields of RECORD) `gold`,
    `tokens`, `chunks` and those of `more`, null where there is none. Counts alone leave the task that makes them."""
    names = ["tokens", "chunks", *more, "combined"]
    schema = pa.schema([("system", pa.string()), *score.COUNTED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(s, m): np.zeros((len(labels), 3), np.int64) for s in names for m, labels in score.LABELS.items()}
        for batch in batches:
            for s, own in _batch_counts(records(batch)).items() if batch.num_rows else ():
                for m, x in own.items():
                    total[s, m] += x
        told = [(s, m, label, *map(int, x)) for (s, m), own in total.items() for label, x in zip(score.LABELS[m], own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), schema, strict=True)], schema=schema)

    told = rows.mapInArrow(run, "system string, metric string, label string, tp long, fp long, fn long")
    none = rows.sparkSession.createDataFrame([(s, m, label, 0, 0, 0) for s in names for m, labels in score.LABELS.items() for label in labels], told.schema)
    counts = told.unionByName(none).groupBy("system", "metric", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    own = [F.when(F.col("system") == s, _in_scope(scope)) for s, scope in SCOPES.items()]
    return score.scored(counts, "system").where(F.coalesce(*own, F.lit(True)))


def compared(gold: DataFrame, tokens: DataFrame, chunks: DataFrame, key: str, **more: DataFrame) -> DataFrame:
    """(system, metric, label, tp, fp, fn, precision, recall, f1) of the systems `tokens`, `chunks`, `combined` and those
    of `more`, all on the rows of gold that every system has a record for. The first two are scored in their scopes."""
    frames = {"gold": gold, "tokens": tokens, "chunks": chunks, **more}
    packed = [X.computed(df, **{name: F.struct("text", "boundaries", "spans", "b_spans", "bunsetsu")}).select(key, name) for name, df in frames.items()]
    names = list(frames)
    return compared_batches(reduce(lambda a, b: a.join(b, key), packed).select(*names), lambda batch: {name: batch[name] for name in names}, *more)
