"""Canonical records: building and the list of all violations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import vocabulary as V
from lexloom.operators import runs

#: Stands for a null among endpoints: after all others, as Spark sorts it.
NULL = 1 << 32


class _Found:
    """Codes found in rows of a batch, each with its place among those of its row."""

    def __init__(self):
        self.row, self.place, self.code, self.part = [], [], [], 0

    def add(self, rows: np.ndarray, code: str, at: np.ndarray | int = 0) -> None:
        """rows have the code; codes of one part are in the order of `at`, then as they are added."""
        self.row.append(rows)
        self.place.append(np.broadcast_to(np.asarray(at, np.int64) + (self.part << 40), rows.shape))
        self.code += [code] * len(rows)

    def lists(self, rows: int) -> pa.Array:
        row, place = np.concatenate(self.row), np.concatenate(self.place)
        order = np.lexsort((place, row))
        return runs.lists(np.bincount(row, minlength=rows), pa.array(self.code, pa.string()).take(pa.array(order)))


class _Ends:
    """Endpoints of a level: the row of each and its value; which rows have a list."""

    def __init__(self, column: pa.Array):
        self.row, values = runs.elements(column)
        self.at, self.there = runs.ints(values, NULL), runs.known(column)

    def keys(self) -> np.ndarray:
        return (self.row << 34) + self.at + (1 << 31)

    def lacking(self, other: _Ends) -> np.ndarray:
        """The rows with an endpoint that the other does not have."""
        own, held = self.keys(), other.keys()
        if (held[1:] < held[:-1]).any():
            held = np.sort(held)
        # most are sorted as they are, which makes these searches short
        at = np.searchsorted(held, own)
        return np.unique(self.row[np.append(held, -1)[at] != own])

    def or_else(self, other: _Ends) -> _Ends:
        """These endpoints, of rows without a list the other's."""
        if self.there.all():
            return self
        out, more = _Ends.__new__(_Ends), ~self.there[other.row]
        out.row, out.at, out.there = np.concatenate([self.row, other.row[more]]), np.concatenate([self.at, other.at[more]]), self.there | other.there
        return out


def _unlisted(values: pa.Array, labels: list[str]) -> np.ndarray:
    return ~pc.fill_null(pc.is_in(values, pa.array(labels)), False).to_numpy(zero_copy_only=False)


def _spans(found: _Found, column: pa.Array, n: np.ndarray, open_: np.ndarray, kind: str, level: _Ends) -> None:
    """Violations of spans in order: range, contiguity, labels (kind a), cover, ends. A span out of range moves nothing."""
    row, own = runs.elements(column)
    own = runs.fields(own)
    start, end = runs.ints(own["start"], -1), runs.ints(own["end"], -1)
    seen = open_[row]
    good = (start >= 0) & (start < end) & (end <= n[row])
    here = np.arange(len(row))
    last_good = np.maximum.accumulate(np.where(good, here, -1)) if len(row) else here
    count = np.bincount(row, minlength=len(n))
    first = np.cumsum(count) - count
    told = lambda at, to: np.where(at >= to, end[np.maximum(at, 0)], 0) if len(end) else np.zeros(len(at), np.int64)
    last = told(np.append(-1, last_good[:-1])[: len(row)], first[row])
    place = (here - first[row]) * 8
    checks = [(~good, f"{kind}_span_out_of_range"), (good & (start != last), f"{kind}_spans_not_contiguous")]
    if kind == "a":
        of, flags = runs.elements(own["inflections"])
        odd = ~runs.known(own["inflections"])
        odd[of[_unlisted(flags, V.INFLECTIONS)]] = True
        checks += [
            (good & _unlisted(own["atom_type"], V.ATOM_TYPES), "invalid_atom_type"), (good & runs.known(own["function"]) & _unlisted(own["function"], V.PARTICLE_FUNCTIONS), "invalid_particle_function"),
            (good & odd, "invalid_inflections"),
        ]
    for k, (bad, code) in enumerate(checks):
        bad = np.flatnonzero(bad & seen)
        found.add(row[bad], code, place[bad] + k)
    found.part += 1
    some = np.flatnonzero(open_ & (count > 0))
    final = told(last_good[first[some] + count[some] - 1], first[some]) if len(some) else some
    found.add(some[final != n[some]], f"{kind}_spans_do_not_cover_text")
    # sorted ends against the level's endpoints as they are
    ends = runs.ints(own["end"], NULL)
    ends = ends[np.lexsort((ends, row))]
    held = np.bincount(level.row, minlength=len(n))
    unlike = count != held
    same = ~unlike
    differ = ends[same[row]] != level.at[same[level.row]]
    unlike[row[same[row]][differ]] = True
    found.add(np.flatnonzero(open_ & (count > 0) & unlike), f"{kind}_spans_do_not_match_{kind}_boundaries", 1)
    if kind == "bunsetsu":
        bad = np.flatnonzero(seen & _unlisted(own["role"], V.BUNSETSU_ROLES))
        found.add(row[bad], "invalid_bunsetsu_role", 2)
    found.part += 1


def codes(text: pa.Array, boundaries: pa.Array, spans: pa.Array, b_spans: pa.Array, bunsetsu: pa.Array) -> pa.Array:
    """The violation codes of all records of a batch; what is checked is found for all at once, and codes are few."""
    found, n = _Found(), runs.sizes_of(text)
    bounded = runs.known(boundaries)
    found.add(np.flatnonzero(n == 0), "text_missing_or_empty")
    found.add(np.flatnonzero((n > 0) & ~bounded), "boundaries_missing")
    open_ = (n > 0) & bounded
    levels = {level: _Ends(x) for level, x in runs.fields(boundaries).items()}
    mine = lambda rows: rows[open_[rows]]
    previous = None
    for level in V.LEVELS:
        found.part += 1
        v = levels[level]
        found.add(np.flatnonzero(open_ & ~v.there), f"{level}_boundaries_not_list")
        falls = (v.row[1:] == v.row[:-1]) & (v.at[1:] <= v.at[:-1])
        found.add(mine(np.unique(v.row[1:][falls])), f"{level}_boundaries_not_sorted_unique", 1)
        found.add(mine(np.unique(v.row[(v.at < 1) | (v.at > n[v.row])])), f"{level}_boundary_out_of_range", 2)
        if previous is not None:
            rows = mine(v.lacking(previous))
            found.add(rows[previous.there[rows]], f"nesting_{level}_not_subset_of_previous", 3)
        previous = v if previous is None else v.or_else(previous)
    for column, kind, missing in ((spans, "a", "spans_missing_or_not_list"), (b_spans, "b", None), (bunsetsu, "bunsetsu", "bunsetsu_missing_or_not_list")):
        found.part += 1
        there = runs.known(column)
        if missing:
            found.add(np.flatnonzero(open_ & ~there), missing)
        _spans(found, column, n, open_ & there, kind, levels[kind])
    for child, parent in zip(V.LEVELS, V.LEVELS[1:], strict=False):
        found.part += 1
        found.add(mine(levels[parent].lacking(levels[child])), f"{parent}_boundaries_missing_in_{child}")
    return found.lists(len(n))


def violations(text: Column, boundaries: Column, spans: Column, b_spans: Column, bunsetsu: Column) -> Column:
    """All violation codes of a record, in order; empty if valid. A null list is not a list; null b_spans are none."""
    return F.arrow_udf(codes, "array<string>")(text, boundaries, spans, b_spans, bunsetsu)
