"""Analysers' tokens to canonical records, or failures: one tagged frame, never an exception."""

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
from lexloom.operators.align import aligned

TOKEN = "struct<surface:string,start:int,end:int,pos:array<string>,normalized_form:string,inflection_form:string,context:map<string,string>>"
CHUNK = "struct<surface:string,start:int,end:int,dependency:string,is_predicate:boolean,particle_function:string>"
RAW = (
    f"text string, source string, document_id string, sudachi_a array<{TOKEN}>, sudachi_b array<{TOKEN}>, ginza_bunsetsu array<{CHUNK}>, "
    "clause_boundaries array<int>, alignment_adjustments array<string>, teacher_versions map<string,string>"
)
TEACHERS = ("sudachi_a", "sudachi_b", "ginza_bunsetsu")


def _atom(t: Column, s: Column) -> Column:
    pos = F.coalesce(t["pos"], F.array().cast("array<string>"))
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), L.atom_type(pos).alias("atom_type"),
        L.particle_function(t["surface"], pos, F.try_element_at(t["context"], F.lit("case"))).alias("function"),
        L.inflections(t["surface"], F.coalesce(t["normalized_form"], F.lit("")), F.coalesce(t["inflection_form"], F.lit(""))).alias("inflections"),
    )


def _field(pos: pa.Array, k: int) -> pa.Array:
    """The field k of each list, null where it is shorter."""
    row, values = runs.elements(pos)
    size = np.bincount(row, minlength=len(pos))
    first = np.cumsum(size) - size
    return values.take(pa.array(first + k, mask=size <= k))


def atoms_of(tokens: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """atom_type, function and inflections of tokens (fields of TOKEN), as those of labels are as columns."""
    pos = [_field(tokens["pos"], k) for k in (0, 1, 4)]
    noun = pc.if_else(pc.fill_null(pc.equal(pos[0], "名詞"), False), runs.look_up(V.NOUN_DETAIL, pos[1]), pa.scalar(None, pa.string()))
    is_copula = pc.and_(pc.fill_null(pc.equal(pos[0], "助動詞"), False), pc.fill_null(pc.is_in(pos[2], pa.array(V.COPULA_TYPES)), False))
    copula = pc.if_else(is_copula, pa.scalar("COPULA"), pa.scalar(None, pa.string()))
    atom = pc.coalesce(noun, copula, runs.look_up(V.POS_ATOM, pos[0]), pa.scalar("OTHER"))
    # functions are those of particles alone
    particle = pc.fill_null(pc.equal(pos[0], "助詞"), False)
    at = pa.array(np.flatnonzero(particle.to_numpy(zero_copy_only=False)))
    surface = tokens["surface"].take(at).cast(pa.string())
    by_case = {"に\0LOC": "LOCATION", "に\0DIR": "DIRECTION", "に\0TIME": "TIME", "と\0QUOTE": "QUOTATIVE", "で\0LOC": "LOCATION"}
    told = runs.look_up(by_case, pc.binary_join_element_wise(surface, pc.map_lookup(tokens["context"].take(at), pa.scalar("case"), "first").cast(pa.string()), "\0"))
    known = pc.coalesce(told, runs.look_up({"に": "UNKNOWN", "で": "UNKNOWN"}, surface), runs.look_up(V.PARTICLE_SURFACE, surface), runs.look_up(V.PARTICLE_DETAIL, pos[1].take(at)), pa.scalar("UNKNOWN"))
    place = np.full(len(particle), -1)
    place[at.to_numpy()] = np.arange(len(at))
    function = known.take(pa.array(place, mask=place < 0))
    names = sorted(V.INFLECTIONS)
    flags = np.zeros((len(particle), len(names)), bool)
    for table, key in ((V.INFLECTION_NORMALIZED, "normalized_form"), (V.INFLECTION_FORM, "inflection_form"), (V.INFLECTION_SURFACE, "surface")):
        which = runs.ints(pc.index_in(tokens[key], pa.array([*table])), -1)
        found = np.flatnonzero(which >= 0)
        flags[found] |= np.array([[x in own for x in names] for own in table.values()])[which[found]]
    return {"atom_type": atom, "function": function, "inflections": runs.flagged(names, flags)}


def roles_of(dependency: pa.Array, function: pa.Array, is_predicate: pa.Array) -> pa.Array:
    """The role of each chunk: topic, then predicate, then by dependency."""
    none, true = pa.scalar(None, pa.string()), lambda x: pc.fill_null(x, False)
    topic = pc.if_else(true(pc.equal(function, "TOPIC")), pa.scalar("TOPIC"), none)
    return pc.coalesce(topic, pc.if_else(true(is_predicate), pa.scalar("PREDICATE"), none), runs.look_up(V.DEPENDENCY_ROLE, pc.utf8_lower(dependency)), pa.scalar("UNKNOWN"))


#: What is found of raw rows: why one is no record, or its labelled spans.
FOUND = (
    "reason string, teacher string, detail string, boundaries struct<" + ", ".join(f"{level}:array<int>" for level in V.LEVELS) + ">, spans array<struct<start:int,end:int,atom_type:string,function:string,inflections:array<string>>>, "
    "b_spans array<struct<start:int,end:int>>, bunsetsu array<struct<start:int,end:int,role:string>>"
)


def _clauses(given: pa.Array, n: np.ndarray) -> pa.Array:
    """Sorted endpoints without repetition, nulls last; the text's end without a list."""
    row, values = runs.elements(given)
    at, there = runs.ints(values, validate.NULL), runs.known(given)
    row, at = np.concatenate([row, np.flatnonzero(~there)]), np.concatenate([at, n[~there]])
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))[: len(row)]
    return runs.lists(np.bincount(row[new], minlength=len(n)), runs.whole(np.where(at < validate.NULL, at, 0)[new], (at < validate.NULL)[new]))


def _not_nested(ends: dict[str, pa.Array]) -> dict[int, str]:
    """By row: the first coarse level with an endpoint that the next finer one lacks, with those endpoints."""
    levels, told = {k: validate._Ends(v) for k, v in ends.items()}, {}
    for fine, coarse in zip(V.LEVELS, V.LEVELS[1:], strict=False):
        for r in levels[coarse].lacking(levels[fine]).tolist():
            lacks = {*ends[coarse][r].as_py()} - {*ends[fine][r].as_py()} - {None}
            told.setdefault(r, f"{coarse} endpoints absent from {fine}: [{', '.join(map(str, sorted(lacks)))}]")
    return told


def _found(least: int, most: int):
    def run(text: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, clauses: pa.Array) -> pa.Array:
        n, rows = runs.sizes_of(text), len(text)
        why = [np.full(rows, None, object) for _ in range(3)]

        def fail(which: np.ndarray, reason, teacher: str, detail) -> None:
            for out, x in zip(why, (reason, teacher, detail), strict=True):
                out[which] = x[which] if isinstance(x, np.ndarray) else x

        short = ~runs.known(text) | (n < least) | (n > most)
        fail(short, "length_out_of_range", "raw", np.array([f"length={x}" for x in n.tolist()], object) if short.any() else None)
        fine = []
        for t, tokens in zip(TEACHERS, (a, b, c), strict=True):
            told = aligned(text, tokens, t)
            still = np.equal(why[0], None)
            fail(still & ~runs.known(tokens), "teacher_missing", t, "")
            fail(still & runs.known(told["reason"]), told["reason"].to_numpy(zero_copy_only=False), t, told["detail"].to_numpy(zero_copy_only=False))
            fine.append(told["spans"])
        at = np.flatnonzero(np.equal(why[0], None))
        own = pa.array(at)
        text, n = text.take(own), n[at]
        tokens, spans = ([runs.fields(x.take(own).flatten()) for x in lists] for lists in ((a, b, c), fine))
        sizes = [pc.list_value_length(x.take(own)).to_numpy(zero_copy_only=False) for x in fine]
        role = roles_of(pc.fill_null(tokens[2]["dependency"], ""), tokens[2]["particle_function"], tokens[2]["is_predicate"])
        made = [runs.struct(**spans[0], **atoms_of(tokens[0])), runs.struct(**spans[1]), runs.struct(**spans[2], role=role)]
        whole = runs.lists(np.ones(len(at), np.int64), runs.whole(n))
        ends = {level: runs.lists(size, x["end"]) for level, size, x in zip(V.LEVELS, sizes, spans, strict=False)} | {"clause": _clauses(clauses.take(own), n), "sentence": whole}
        odd = {int(at[r]): ("teacher_boundary_disagreement", "cross_teacher", x) for r, x in _not_nested(ends).items()}
        codes = validate.codes(text, runs.struct(**ends), *[runs.lists(size, x) for size, x in zip(sizes, made, strict=True)])
        for r in np.flatnonzero(pc.list_value_length(codes).to_numpy(zero_copy_only=False)).tolist():
            odd.setdefault(int(at[r]), ("canonical_invariant_failure", "compiler", ";".join(codes[r].as_py())))
        for r, x in odd.items():
            fail(np.array([r]), *x)
        there = np.zeros(rows, bool)
        there[at] = True
        back = lambda size, values: runs.some_lists(there, size, values)
        bounds = [back(pc.list_value_length(ends[level]).to_numpy(zero_copy_only=False), ends[level].flatten()) for level in V.LEVELS]
        return runs.struct(
            **dict(zip(("reason", "teacher", "detail"), (pa.array(x, pa.string()) for x in why), strict=True)), boundaries=runs.struct(**dict(zip(V.LEVELS, bounds, strict=True))),
            **{name: back(size, x) for name, size, x in zip(("spans", "b_spans", "bunsetsu"), sizes, made, strict=True)},
        )

    return run


def compile_records(raw: DataFrame, least: int = 4, most: int = 128) -> DataFrame:
    """raw (schema RAW) with `record` or `failure`, exactly one of them not null.

    The first of these decides: length, each analyser missing or misaligned in turn, endpoints not nested, violations.
    Alignment, labels and checks are made of whole Arrow batches.
    """
    found = F.arrow_udf(_found(least, most), f"struct<{FOUND}>")("text", *TEACHERS, "clause_boundaries")
    metadata = F.struct(
        F.lit(V.MAPPING_VERSION).alias("mapping_version"), F.coalesce("teacher_versions", F.create_map().cast("map<string,string>")).alias("teacher_versions"),
        F.coalesce("alignment_adjustments", F.array().cast("array<string>")).alias("alignment_adjustments"),
    )
    record = F.struct(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"), "text", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("document_id", F.lit("")).alias("document_id"),
        *[F.col(f"_found.{c}").alias(c) for c in ("boundaries", "spans", "b_spans", "bunsetsu")], metadata.alias("metadata"),
    )
    failure = F.struct("source", "document_id", "text", *[F.col(f"_found.{c}").alias(c) for c in ("reason", "teacher", "detail")])
    good = F.col("_found.reason").isNull()
    return raw.withColumn("_found", found).select(*raw.columns, F.when(good, record).alias("record"), F.when(~good, failure).alias("failure"))


def records(compiled: DataFrame) -> DataFrame:
    return compiled.where("record is not null").select("record.*")


def failures(compiled: DataFrame) -> DataFrame:
    return compiled.where("failure is not null").select("failure.*")
