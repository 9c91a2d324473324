"""Analysers that stand in for morphological ones, which the tables' languages have none of. They say what simple patterns
say, and fail on some texts, as real ones do; not linguistic."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.operators import runs

FINE, COARSE, CHUNK = re.compile("[A-Za-z]+|[0-9]+| +|[^A-Za-z0-9 ]"), re.compile("[^ ]+ *| +"), re.compile("[^,.;:!?]+[,.;:!?]*|[,.;:!?]+")
#: Texts whose length these divide make the analyser of tokens, or of chunks, fail.
TOKENS_FAIL, CHUNKS_FAIL = 11, 13


def _pos(surface: str) -> tuple[list[str], str]:
    """Part of speech and normalized form."""
    if surface[0] == " ":
        return ["空白"], surface
    if surface[0] in "0123456789":
        return ["名詞", "数詞"], surface
    if not (surface.isascii() and surface.isalpha()):
        return ["補助記号"], surface
    if len(surface) <= 2:
        return ["助詞", "係助詞"], surface
    return (["動詞"], "た") if len(surface) % 5 == 0 else (["名詞", "普通名詞"], surface)


def _token(surface: str) -> dict:
    pos, normalized = _pos(surface)
    return {"surface": surface, "start": None, "end": None, "pos": pos, "normalized_form": normalized, "inflection_form": "", "context": {}}


def token_analyser():
    def analyse(texts: list[str]) -> list[dict]:
        for t in texts:
            if len(t) % TOKENS_FAIL == 0:
                raise ValueError("no tokens for this length")
        return [{"a": [_token(s) for s in FINE.findall(t)], "b": [_token(s) for s in COARSE.findall(t)]} for t in texts]

    return analyse


def _chunks(text: str) -> list[dict]:
    out = []
    for m in CHUNK.finditer(text):
        own = m.group().strip(" ")
        if own:
            start = m.start() + len(m.group()) - len(m.group().lstrip(" "))
            dependency = "root" if own[-1] == "." else "obj" if own[-1] == "," else "nmod"
            out.append({"start": start, "end": start + len(own), "dependency": dependency, "topic": len(own) % 4 == 0, "is_predicate": own[-1] == "."})
    return out


def chunk_analyser():
    def analyse(texts: list[str]) -> list[dict]:
        for t in texts:
            if len(t) % CHUNKS_FAIL == 0:
                raise ValueError("no chunks for this length")
        return [{"chunks": _chunks(t)} for t in texts]

    return analyse


def raw_analyser():
    """Tokens and chunks of compile.RAW, null where the analyser of either fails; white space joins the chunk before it."""
    chunk = ("surface", "start", "end", "dependency", "is_predicate", "particle_function")

    def one(text: str) -> dict:
        own = _chunks(text)
        ends = [c["start"] for c in own[1:]] + [len(text)]
        cut = [dict(zip(chunk, (text[a:b], None, None, c["dependency"], c["is_predicate"], "TOPIC" if c["topic"] else None), strict=True)) for c, a, b in zip(own, [0, *ends], ends, strict=False)]
        tokens = len(text) % TOKENS_FAIL != 0
        return {
            "sudachi_a": [_token(s) for s in FINE.findall(text)] if tokens else None, "sudachi_b": [_token(s) for s in COARSE.findall(text)] if tokens else None,
            "ginza_bunsetsu": cut if own and len(text) % CHUNKS_FAIL else None,
        }

    return lambda texts: [one(t) for t in texts]


#: Kinds of tokens, as _pos tells them apart: white space, digits, marks, short words, words of five letters (ten, ...), others.
_KINDS = [["空白"], ["名詞", "数詞"], ["補助記号"], ["助詞", "係助詞"], ["動詞"], ["名詞", "普通名詞"]]
_VERB = 4


def _surfaces(own: runs.Cut, text: pa.Array, points: np.ndarray) -> pa.Array:
    """The texts of spans that tile all texts: the texts' bytes with other offsets."""
    ends = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
    offsets = np.append(0, ends[own.at]).astype(np.int32)
    return pa.StringArray.from_buffers(len(own.at), pa.py_buffer(offsets), pa.py_buffer("".join(text.to_pylist()).encode()))


def _tokens(own: runs.Cut, text: pa.Array, points: np.ndarray) -> pa.Array:
    size = own.end - own.start
    first = points[own.at - size + 1]
    letters = np.cumsum(((points | 32) >= 97) & ((points | 32) <= 122))
    solid = np.diff(letters[own.at], prepend=0) == size
    kind = np.select([first == 32, (first >= 48) & (first <= 57), ~solid, size <= 2, size % 5 == 0], range(5), 5)
    surface, none, count = _surfaces(own, text, points), pa.nulls(len(size), pa.int32()), len(size)
    context = pa.MapArray.from_arrays(pa.array(np.zeros(count + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    token = runs.struct(
        surface=surface, start=none, end=none, pos=pa.array(_KINDS).take(runs.whole(kind)), normalized_form=pc.if_else(pa.array(kind == _VERB), "た", surface),
        inflection_form=pa.array(np.full(count, "")), context=context,
    )
    return own.lists(token)


def _placed(there: np.ndarray, lists: pa.Array) -> pa.Array:
    return runs.some_lists(there, pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten())


def token_arrays(text: pa.Array) -> pa.Array:
    """What token_analyser says of all texts of an Arrow batch, made at once: struct(a, b), null where it fails."""
    n = runs.sizes_of(text)
    there = n % TOKENS_FAIL != 0
    own, sizes = text.filter(pa.array(there)), n[there]
    points = runs.points_of(own)
    space, lower = points == 32, points | 32
    kind = np.select([(lower >= 97) & (lower <= 122), (points >= 48) & (points <= 57), space], [1, 2, 3], 0)
    fine = np.append((kind[1:] != kind[:-1]) | (kind[1:] == 0), True)[: len(points)]
    coarse = np.append(space[:-1] & ~space[1:], True)[: len(points)]
    both = [_placed(there, _tokens(runs.cut(ends, sizes), own, points)) for ends in (fine, coarse)]
    return pa.StructArray.from_arrays(both, names=["a", "b"], mask=pa.array(~there))


def raw_arrays(text: pa.Array) -> pa.Array:
    """What raw_analyser says of all texts of an Arrow batch, made at once."""
    tokens = runs.fields(token_arrays(text))
    return runs.struct(sudachi_a=tokens["a"], sudachi_b=tokens["b"], ginza_bunsetsu=_raw_chunks(text, runs.sizes_of(text)))


class _Chunks:
    """The chunks of texts: the row of each, its first and last character among those of all texts, and their labels."""

    def __init__(self, text: pa.Array, sizes: np.ndarray):
        self.points = points = runs.points_of(text)
        mark = np.isin(points, [ord(x) for x in ",.;:!?"])
        own = runs.cut(np.append(mark[:-1] & ~mark[1:], True)[: len(points)], sizes)
        solid = np.flatnonzero(points != 32)
        low, high = (np.searchsorted(solid, x) for x in (own.at - (own.end - own.start) + 1, own.at + 1))
        some = high > low
        self.start, self.last, self.row = solid[low[some]], solid[high[some] - 1], own.row[some]
        at = points[self.last]
        self.dependency = pa.array(["root", "obj", "nmod"]).take(runs.whole(np.select([at == ord("."), at == ord(",")], [0, 1], 2)))
        self.is_predicate, self.topic = at == ord("."), (self.last + 1 - self.start) % 4 == 0


def chunk_arrays(text: pa.Array) -> pa.Array:
    """What chunk_analyser says of all texts of an Arrow batch, made at once: lists of chunks, null where it fails."""
    n = runs.sizes_of(text)
    there = n % CHUNKS_FAIL != 0
    sizes = n[there]
    own = _Chunks(text.filter(pa.array(there)), sizes)
    first = (np.cumsum(sizes) - sizes)[own.row]
    chunk = runs.struct(start=runs.whole(own.start - first), end=runs.whole(own.last + 1 - first), dependency=own.dependency, topic=pa.array(own.topic), is_predicate=pa.array(own.is_predicate))
    return runs.some_lists(there, np.bincount(own.row, minlength=len(sizes)), chunk)


def _raw_chunks(text: pa.Array, n: np.ndarray) -> pa.Array:
    # texts of white space alone have no chunks
    there = (n % CHUNKS_FAIL != 0) & (runs.sizes_of(pc.utf8_trim(text, " ")) > 0)
    text, sizes = text.filter(pa.array(there)), n[there]
    own = _Chunks(text, sizes)
    # each takes the white space after it, the first what is before it
    ends = np.zeros(len(own.points), bool)
    ends[own.start[1:][own.row[1:] == own.row[:-1]] - 1] = True
    wide, none = runs.cut(ends, sizes), pa.nulls(len(own.row), pa.int32())
    topic = runs.named(["TOPIC"], np.zeros(len(own.row), np.int64), own.topic)
    chunk = runs.struct(surface=_surfaces(wide, text, own.points), start=none, end=none, dependency=own.dependency, is_predicate=pa.array(own.is_predicate), particle_function=topic)
    return _placed(there, wide.lists(chunk))
