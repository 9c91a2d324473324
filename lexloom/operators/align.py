"""Strict alignment of analysers' tokens to the text, without search or normalization."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import runs


def _quoted(x: Column) -> Column:
    """The surface as Python shows a string: quoted (in double quotes if it holds a single one alone), with escapes for
    backslashes, the quote, and what cannot be printed; None of a null."""
    quote = F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), '"').otherwise("'")

    def shown(c: Column) -> Column:
        point, digits = F.ascii(c), F.lower(F.hex(F.ascii(c)))
        escaped = F.when(point < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).when(point < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        named = F.when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == quote, F.concat(F.lit("\\"), c))
        return named.when(c == " ", c).when(c.rlike("^[\\p{C}\\p{Z}]"), escaped).otherwise(c)

    return F.coalesce(F.concat(quote, F.array_join(F.transform(X.chars(x), shown), ""), quote), F.lit("None"))


def align(text: Column, tokens: Column, teacher: str, offsets: bool = True) -> Column:
    """struct(reason, teacher, token_index, detail, spans) of tokens (surface, and start, end if offsets).

    A token must equal the text at the cursor; offsets, where given, must be both there, begin at the cursor and hold the
    surface. The first token that fails decides; all tokens together must cover the text. spans are null after a failure.

    A batch of texts is aligned at once: where all surfaces tile a text, and offsets given are theirs, ends are a running
    sum of lengths; of other texts the tokens are read one by one.
    """

    def told(x: pa.Array, t: pa.Array) -> pa.Array:
        found = aligned(x, t, teacher, offsets)
        return pa.StructArray.from_arrays(list(found.values()), names=list(found), mask=t.is_null())

    return F.arrow_udf(told, ALIGNED)(text, tokens)


ALIGNED = "struct<reason:string,teacher:string,token_index:int,detail:string,spans:array<struct<start:int,end:int>>>"


def _failure(text: str | None, surfaces: list, starts: list, ends: list) -> tuple[str | None, int, str | None, list[int]]:
    """Why tokens are not aligned (or None), how many are before that, its detail, and the ends of those before."""
    cursor, held = 0, []
    for surface, a, b in zip(surfaces, starts, ends, strict=True):
        given = a is not None or b is not None
        if not surface:
            return "empty_surface", len(held), repr(surface), held
        if given and (a is None or b is None):
            return "invalid_teacher_offsets", len(held), f"({a}, {b})", held
        if given and a != cursor:
            return "non_monotonic_offset", len(held), f"expected {cursor}, got {a}", held
        end = b if given else cursor + len(surface)
        if text is not None and text[cursor : max(cursor, end)] != surface:
            return ("surface_offset_mismatch", len(held), repr(surface), held) if given else ("surface_mismatch", len(held), f"at raw offset {cursor}: {surface!r}", held)
        cursor = end
        held.append(end)
    if text is not None and cursor != len(text):
        return "teacher_does_not_cover_text", len(held), f"covered {cursor}/{len(text)} codepoints", held
    return None, len(held), None, held


def aligned(text: pa.Array, tokens: pa.Array, teacher: str, offsets: bool = True) -> dict[str, pa.Array]:
    """The fields of ALIGNED for all texts; those of null tokens are null."""
    row, own = runs.elements(tokens)
    own, rows, there = runs.fields(own), len(text), runs.known(tokens)
    count = np.bincount(row, minlength=rows)
    size = runs.sizes_of(own["surface"])
    end = np.cumsum(size)
    before = np.cumsum(count) - count
    end = end - np.append(0, end)[before][row]
    right = size > 0
    if offsets:
        given = runs.known(own["start"]) | runs.known(own["end"])
        right &= ~given | ((runs.ints(own["start"], -1) == end - size) & (runs.ints(own["end"], -1) == end))
    # a text is tiled if its tokens' surfaces, joined, are the text
    joined = pc.binary_join(runs.lists(count, pc.fill_null(own["surface"], "").cast(pa.string())), "")
    good = there & pc.fill_null(pc.equal(joined, text.cast(pa.string())), False).to_numpy(zero_copy_only=False) & (np.bincount(row, ~right, rows) == 0)
    reason, detail, index = np.full(rows, None, object), np.full(rows, None, object), count.copy()
    odd = np.flatnonzero(there & ~good)
    if len(odd):
        sides = [own[c].take(pa.array(np.flatnonzero(np.isin(row, odd)))).to_pylist() for c in (("surface", "start", "end") if offsets else ("surface",))]
        sides += [[None] * len(sides[0])] * (3 - len(sides))
        at = 0
        for r in odd.tolist():
            part = [x[at : at + count[r]] for x in sides]
            at += count[r]
            reason[r], index[r], detail[r], held = _failure(text[r].as_py(), *part)
            if reason[r] is None:
                # without a text, or by offsets that are not of its length
                good[r], end[before[r] : before[r] + count[r]] = True, held
    kept = good[row]
    last = end[kept]
    start = np.append(0, last[:-1])[: len(last)]
    start[(np.cumsum(count[good]) - count[good])[count[good] > 0]] = 0
    spans = runs.struct(start=runs.whole(start), end=runs.whole(last))
    return {
        "reason": pa.array(reason, pa.string()), "teacher": pa.array(np.where(there, teacher, None), pa.string()), "token_index": runs.whole(index, there), "detail": pa.array(detail, pa.string()),
        "spans": runs.some_lists(good, count[good], spans),
    }
