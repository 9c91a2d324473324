"""LM scoring by a gated recurrent language model with class-factored output.

Words are counted over all training documents. The most frequent are outputs of the model; each other word belongs to a
kind, an output that its spelling gives (beyond-ASCII letter, ending, length). Outputs are in classes of equal mass of
the square root of frequency, so that frequent ones have small classes. The model gives P(class | state) and P(output |
class, state); within a kind, words have their smoothed share of the kind. The state is a gated mean of what it was and
of a candidate. It is trained by truncated backpropagation in numpy on every training document, once: a hash of what a
document holds gives it a round, a stream and a place in it; in each round every stream trains on its documents block by
block, then the streams' weights are averaged. There are as many streams as the tokens ask for, however the table is
cut, so the same documents give the same scores in any partitioning. A document's score carries the state through the whole document, window by window.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import NOT_SPACE, Words, array_sums, checkpointed, hashes, lists, pieces, remainder, table, text_bytes, tidy

#: Words of the model, classes, size of the state and of word vectors.
MODEL_WORDS, CLASSES, STATE, VECTOR = 2000, 12, 32, 16
#: Words whose counts are broadcast (16 bytes each); counts of rarer words are joined by a shuffle.
KNOWN_WORDS = 400_000
#: The training documents are dealt to ROUNDS; lanes and steps of a window of backpropagation.
ROUNDS, LANES, STEPS, RATE = 6, 32, 24, 0.008
#: Tokens of a stream in a round, about.
STREAM_TOKENS = 1 << 20
#: Blocks after a stream's first of the first round have WIDE lanes; a block is WINDOWS windows, all that a task holds of its
#: documents at once.
WIDE, WINDOWS = 512, 32
#: Rows of the output layer that training works on at once.
ROWS = 2048
#: Tokens that a task scores at once, and documents that run side by side.
SCORED_TOKENS, SIDE_BY_SIDE = 3_000_000, 512
#: Logits are at most this, so that none overflows.
TOP = 60.0
SMOOTH = 0.1
KINDS = 9 * 4 * 4
#: Part of a weight vector that is one row while tasks' weights are averaged.
PART = 4096


def kinds(words: pa.Array) -> np.ndarray:
    """The kind of each word: its first letter beyond ASCII (8 groups or none), its last byte, its length."""
    data, offsets = text_bytes(words)
    sizes = np.diff(offsets)
    last = data[np.maximum(0, offsets[1:] - 1)] if len(data) else np.zeros(len(sizes), np.uint8)
    ending = np.select([(last >= 97) & (last <= 122) | (last >= 128), (last >= 48) & (last <= 57), np.isin(last, list(b".,;:!?'\")-"))], [0, 1, 2], 3)
    length = np.searchsorted([4, 8, 14], sizes)
    high = np.flatnonzero(data >= 192)
    of = np.searchsorted(offsets, high, side="right") - 1
    of, at = np.unique(of, return_index=True)
    letter = np.zeros(len(sizes), np.int64)
    letter[of] = 1 + (data[np.minimum(high[at] + 1, len(data) - 1)].astype(np.int64) * 5 + data[high[at]]) % 8
    return (letter * 4 + ending) * 4 + length


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, count) of the words of a task; the end of documents is word 0 of kind -1."""
    held: list[list[np.ndarray]] = []

    def merged() -> list[np.ndarray]:
        h, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
        words, first, at = np.unique(h, return_index=True, return_inverse=True)
        return [words, k[first], np.bincount(at, c).astype(np.int64)]

    documents = 0
    for batch in pieces(batches):
        words = Words(batch["text"], NOT_SPACE)
        held.append([hashes(words.distinct), kinds(words.distinct), np.bincount(words.codes, minlength=len(words.distinct))])
        documents += batch.num_rows
        if sum(len(x[0]) for x in held) > 2_000_000:
            held = [merged()]
            if len(held[0][0]) > 1_000_000:
                yield _counts(*held.pop())
    if held:
        yield _counts(*merged())
    yield _counts(np.zeros(1, np.uint64), np.array([-1]), np.array([documents]))


def _counts(words: np.ndarray, kind: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["word", "kind", "count"])


class Vocabulary:
    """Outputs of the model (0 is the end, then words and kinds, frequent ones first), counts of known words, and what is
    left to each kind."""

    def __init__(self, words: np.ndarray, kind: np.ndarray, counts: np.ndarray, ends: int, total: int, distinct: int, by_kind: dict[int, tuple[int, int]]):
        order = np.argsort(words)
        self.words, self.kind, self.counts = words[order], kind[order], counts[order]
        self.ends, self.total, self.distinct = ends, total, distinct
        best = np.lexsort((self.words, -self.counts))[: MODEL_WORDS - 1]
        self.size = len(best) + 1
        self.kind_total, self.kind_distinct = np.zeros(KINDS), np.zeros(KINDS)
        for k, (n, v) in by_kind.items():
            self.kind_total[k], self.kind_distinct[k] = n, v
        np.subtract.at(self.kind_total, self.kind[best], self.counts[best])
        np.subtract.at(self.kind_distinct, self.kind[best], 1)
        self.code = np.full(len(self.words), -1, np.int32)
        mass = np.concatenate([self.counts[best], self.kind_total])
        place = np.empty(len(mass), np.int32)
        place[np.argsort(-mass, kind="stable")] = np.arange(1, len(mass) + 1)
        self.code[best], self.kind_code = place[: len(best)], place[len(best) :]
        self.is_kind = np.zeros(self.size + KINDS, bool)
        self.is_kind[self.kind_code] = True
        self.model_counts = np.concatenate([[ends], np.sort(mass)[::-1]])
        # class 0 is the end
        root = np.sqrt(self.model_counts[1:] + 1)
        cut = np.floor((np.cumsum(root) - root / 2) / root.sum() * (CLASSES - 1)).astype(np.int64)
        self.class_of = np.concatenate([[0], 1 + np.unique(cut, return_inverse=True)[1]])
        self.classes = int(self.class_of[-1]) + 1
        #: where each class begins among the outputs, and their number
        self.bounds = np.searchsorted(self.class_of, np.arange(self.classes + 1))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((np.maximum(0, counts) + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def in_kind(self, counts: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.log10((np.maximum(0, counts) + SMOOTH) / (self.kind_total[kind] + SMOOTH * (self.kind_distinct[kind] + 1)))

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: hash, kind, code (output of the word or its kind) and count (-1: not known here)."""
        h, kind = hashes(words.distinct), kinds(words.distinct)
        if not len(self.words):
            return h, kind, self.kind_code[kind], np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        code = np.where(known & (self.code[at] > 0), self.code[at], self.kind_code[kind])
        return h, kind, code, np.where(known, self.counts[at], -1)


def _with_end(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + len(counts), np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)] = codes
    return out


class Model:
    """The weights: one flat vector and views of it by name."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        v, h, d = vocabulary, STATE, VECTOR
        outputs = v.size + KINDS
        self.v = v
        self.shapes = {"e": (outputs, d), "wx": (d, 2 * h), "b": (2 * h,), "u": (h, 2 * h), "wc": (h, v.classes), "bc": (v.classes,), "wo": (outputs, h), "bo": (outputs,)}
        n = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(n, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in self.shapes.items():
            setattr(self, name, self.flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))
        if flat is None:
            rng = np.random.default_rng(5)
            self.e[:] = rng.normal(0, 0.3, self.e.shape)
            self.wx[:], self.u[:] = rng.normal(0, d**-0.5, self.wx.shape), rng.normal(0, h**-0.5, self.u.shape)
            # at first the model is the unigram model
            mass = np.bincount(v.class_of, v.model_counts, v.classes)
            self.bc[:] = np.log((mass + 1) / (mass.sum() + len(mass)))
            self.bo[:] = np.log(v.model_counts + 0.5)

    def in_classes(self, classes: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """For ascending classes of targets: rows whose class has outputs to choose from, and the outputs, by class."""
        rows = np.searchsorted(classes, np.arange(self.v.classes + 1)).tolist()
        outputs = self.v.bounds.tolist()
        for c in range(1, self.v.classes):
            if rows[c] < rows[c + 1] and outputs[c + 1] - outputs[c] > 1:
                yield slice(rows[c], rows[c + 1]), slice(outputs[c], outputs[c + 1])

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after h: the first half of the units opens (1 + tanh) / 2 of the way to the candidate, the second."""
        t = h @ self.u
        t += x
        np.tanh(t, out=t)
        change = t[:, STATE:] - h
        change *= 0.5
        change += change * t[:, :STATE]
        change += h
        return change

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log P(target | state): of the word for words of the model, of the kind for others."""
        out = np.empty(len(targets), np.float32)
        for a in range(0, len(targets), 8192):
            t = targets[a : a + 8192]
            order = np.argsort(self.v.class_of[t], kind="stable")
            s, t = states[a : a + 8192][order], t[order]
            c = self.v.class_of[t]
            logits = s @ self.wc
            logits += self.bc
            np.minimum(logits, TOP, out=logits)
            own = logits[np.arange(len(t)), c]
            np.exp(logits, out=logits)
            own -= np.log(logits @ np.ones(logits.shape[1], logits.dtype))
            for rows, outputs in self.in_classes(c):
                within = s[rows] @ self.wo[outputs].T
                within += self.bo[outputs]
                np.minimum(within, TOP, out=within)
                own[rows] += within[np.arange(len(within)), t[rows] - outputs.start]
                np.exp(within, out=within)
                own[rows] -= np.log(within @ np.ones(within.shape[1], within.dtype))
            out[a : a + 8192][order] = own
        return out

    def score(self, codes: np.ndarray, sizes: np.ndarray, steps: int = 16) -> np.ndarray:
        """log P of each document (its end included): SIDE_BY_SIDE documents at a time, the longest first."""
        order, out = np.argsort(-sizes, kind="stable"), np.empty(len(sizes))
        starts, x = np.cumsum(sizes) - sizes, self.e @ self.wx + self.b
        for at in range(0, len(order), SIDE_BY_SIDE):
            own = order[at : at + SIDE_BY_SIDE]
            out[own] = self._score(x, codes, starts[own], sizes[own], steps)
        return out

    def _score(self, x: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """log P of documents, longest first, so that those still running are always the first rows; the state goes on
        from window to window."""
        h = np.zeros((len(lengths), STATE), np.float32)
        total, running, longest = np.zeros(len(lengths)), len(lengths), int(lengths[0])
        for t0 in range(0, longest, steps):
            states, targets, who = [], [], []
            for t in range(t0, min(t0 + steps, longest)):
                while running and lengths[running - 1] <= t:
                    running = int(np.searchsorted(-lengths, -t, side="left"))
                at = starts[:running] + t
                last = codes[at - 1] if t else np.zeros(running, np.int32)
                h = self.step(x[last], h[:running])
                states.append(h)
                targets.append(codes[at])
                who.append(running)
            own = self.log_probabilities(np.concatenate(states), np.concatenate(targets))
            a = 0
            for n in who:
                total[:n] += own[a : a + n]
                a += n
        return total

    def window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients over one window (lanes, steps) and the state after it. An input of 0 begins a document."""
        g = Model(self.v, np.zeros_like(self.flat))
        lanes, steps = inputs.shape
        k, read = STATE, inputs.T.reshape(-1)
        x = (self.e @ self.wx + self.b)[read].reshape(steps, lanes, 2 * k)
        going = (inputs.T != 0).astype(x.dtype)[:, :, None]
        before, after = (np.empty((steps, lanes, k), x.dtype) for _ in range(2))
        for t in range(steps):
            h = np.multiply(h, going[t], out=before[t])
            own = x[t]
            own += h @ self.u
            np.tanh(own, out=own)
            change = np.subtract(own[:, k:], h, out=after[t])
            change *= 0.5
            change += change * own[:, :k]
            h = np.add(change, h, out=change)
        ds = self._output_gradient(g, after.reshape(-1, k), targets.T.reshape(-1)).reshape(steps, lanes, k)
        # half of the gate times half of what the candidate differs by; x holds tanh of both
        gate, candidate = x[:, :, :k], x[:, :, k:]
        to_gate = candidate - before
        to_gate *= 0.5 - 0.5 * gate * gate
        opened = 0.5 + 0.5 * gate
        to_candidate = 1 - candidate * candidate
        to_candidate *= opened
        kept = np.subtract(1, opened, out=opened)
        kept *= going
        dx, carry, back = np.empty_like(x), np.zeros_like(h), np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            dh = ds[t]
            dh += carry
            np.multiply(dh, to_gate[t], out=dx[t, :, :k])
            np.multiply(dh, to_candidate[t], out=dx[t, :, k:])
            np.matmul(dx[t], back, out=carry)
            carry *= going[t]
            carry += np.multiply(dh, kept[t], out=dh)
        flat = dx.reshape(-1, 2 * k)
        g.u[:] = before.reshape(-1, k).T @ flat
        g.wx[:], g.b[:] = self.e[read].T @ flat, np.ones(len(flat), flat.dtype) @ flat
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.diff(read[order], prepend=-1))
        g.e[read[order][first]] = np.add.reduceat(np.ascontiguousarray((flat @ self.wx.T)[order].T), first, axis=1).T
        return g.flat, h

    def _output_gradient(self, g: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The gradient by states of the mean loss of targets; those of the output's weights go into g."""
        order = np.argsort(self.v.class_of[targets], kind="stable")
        s, target = states[order], targets[order]
        c, ds, each = self.v.class_of[target], np.empty_like(states), 1 / len(targets)

        def errors(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
            np.exp(logits, out=logits)
            logits *= (each / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None].astype(logits.dtype)
            logits[np.arange(len(right)), right] -= each
            return logits

        for at in range(0, len(c), ROWS):
            part = slice(at, at + ROWS)
            d = errors(s[part] @ self.wc + self.bc, c[part])
            g.wc += s[part].T @ d
            g.bc += np.ones(len(d), d.dtype) @ d
            np.matmul(d, self.wc.T, out=ds[part])
        for rows, outputs in self.in_classes(c):
            own, words = s[rows], self.wo[outputs]
            d = errors(own @ words.T + self.bo[outputs], target[rows] - outputs.start)
            np.matmul(d.T, own, out=g.wo[outputs])
            np.matmul(np.ones(len(d), d.dtype), d, out=g.bo[outputs])
            ds[rows] += d @ words
        out = np.empty_like(ds)
        out[order] = ds
        return out

    def train(self, streams: Iterable[np.ndarray], rate: float, lanes: int = LANES) -> int:
        """Adam over the streams (documents, each with its end), block by block, each cut into lanes; the tokens trained
        on, which are all."""
        m, v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        i = total = 0
        for before, targets, lanes in _blocks(streams, lanes):
            h = np.zeros((len(targets), STATE), np.float32)
            for t in range(0, targets.shape[1], STEPS):
                own = targets[:, t : t + STEPS]
                gradient, h = self.window(before[:, t : t + STEPS], own, h)
                # the last windows are small; each token weighs the same
                size = float(np.linalg.norm(gradient))
                if not np.isfinite(size):
                    continue
                gradient *= min(1.0, 5.0 / (size + 1e-9)) * own.size / (lanes * STEPS)
                i += 1
                m *= 0.9
                m += 0.1 * gradient
                v *= 0.99
                gradient *= gradient
                v += np.multiply(gradient, 0.01, out=gradient)
                by = np.sqrt(np.multiply(v, 1 / (1 - 0.99**i), out=gradient), out=gradient)
                by += 1e-6
                self.flat -= np.divide(m, by, out=by) * (rate / (1 - 0.9**i))
            total += targets.size
        return total


def _blocks(streams: Iterable[np.ndarray], lanes: int = LANES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(inputs, targets, lanes of a whole block) of the tokens of all streams, each token a target once. The first block
    has `lanes`: few, where the weights are new, so that little data still gives many steps."""
    last, held = 0, np.zeros(0, np.int32)

    def cut(most: int) -> tuple[np.ndarray, np.ndarray, int]:
        nonlocal last, held
        own = max(1, min(lanes, most // STEPS))
        n = most // own * own
        block, before = held[:n], np.concatenate([[last], held[: n - 1]])
        last, held = held[n - 1], held[n:]
        return before.reshape(own, -1), block.reshape(own, -1), lanes

    for stream in streams:
        held = np.concatenate([held, stream])
        while len(held) >= lanes * STEPS * WINDOWS:
            yield cut(lanes * STEPS * WINDOWS)
            lanes = WIDE
    while len(held):
        yield cut(len(held))


def _sequences(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch["text"], NOT_SPACE)
            codes = _with_end(vocabulary.value.look_up(words)[2][words.codes], words.counts)
            yield pa.RecordBatch.from_arrays([batch["round"], batch["stream"], batch["place"], lists(codes.astype(np.int16), words.counts + 1)], names=["round", "stream", "place", "codes"])

    return run


def hold_memory() -> None:
    """From now on freed arrays of a window are used again, not given back to the system each time."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 32 << 20)  # arrays up to this size are of the heap
        mallopt(-1, 64 << 20)  # free memory at the heap's end that is kept


def _train(vocabulary, weights, rate: float, lanes: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()

        def runs() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                stream = b["stream"].to_numpy()
                ends = np.append(np.flatnonzero(np.diff(stream)) + 1, len(stream)) if len(stream) else []
                for a, e in zip(np.append(0, ends[:-1]).astype(int), ends, strict=True) if len(stream) else ():
                    yield int(stream[a]), np.asarray(b["codes"].slice(a, e - a).flatten())

        for _, own in itertools.groupby(runs(), key=lambda x: x[0]):
            model = Model(vocabulary.value, weights.value)
            n = model.train((codes for _, codes in own), rate, lanes)
            flat = np.append(model.flat.astype(np.float64) * n, n)
            sizes = np.diff(np.append(np.arange(0, len(flat), PART), len(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int32()), lists(flat, sizes)], names=["place", "sums"])

    return run


def _score(vocabulary, weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model = Model(v, weights.value)
        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            sizes = np.concatenate([h[2] for h in held])
            score = model.score(np.concatenate([h[1] for h in held]), sizes) / np.log(10)
            ids, _, _, base, inner, known, tails = zip(*held, strict=True)
            tail = [np.concatenate(x) for x in zip(*tails, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(sizes), pa.array(np.concatenate(known)), pa.array(np.concatenate(base)), pa.array(score + np.concatenate(inner)), lists(tail[0].view(np.int64), tail[3]), lists(tail[1], tail[3]), lists(tail[2], tail[3])],
                names=["doc_id", "n_tokens", "known", "base", "score", "words", "times", "kinds"],
            )

        for batch in pieces(batches):
            words = Words(batch["text"], NOT_SPACE)
            h, kind, code, count = v.look_up(words)
            n, of, w = batch.num_rows, words.of(), words.codes
            here = count[w] >= 0
            of_kind = here & v.is_kind[code[w]]
            base = np.bincount(of[here], v.base(count)[w[here]], n) + v.base(np.array([v.ends]))[0]
            inner = np.bincount(of[of_kind], v.in_kind(count, kind)[w[of_kind]], n)
            known = np.bincount(of[here], minlength=n) + (v.ends > 0)
            pairs, times = np.unique(of[~here] * np.int64(len(h) + 1) + w[~here], return_counts=True)
            rare = pairs % (len(h) + 1)
            tail = (h[rare], times.astype(np.int32), kind[rare].astype(np.int16), np.bincount(pairs // (len(h) + 1), minlength=n))
            held.append((batch["doc_id"], _with_end(code[w], words.counts), words.counts + 1, base, inner, known.astype(np.int64), tail))
            if sum(len(x[1]) for x in held) >= SCORED_TOKENS:
                yield rows()
                held = []
        if held:
            yield rows()

    return run


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The vocabulary of (word, kind, count); at most KNOWN_WORDS words are brought to the driver."""
    ends = counts.where("kind < 0").agg(F.sum("count")).head()[0] or 0
    words = counts.where("kind >= 0")
    by_kind = {r["kind"]: (r["n"], r["v"]) for r in words.groupBy("kind").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}
    size = F.floor(16 * F.log2("count"))
    n, least = 0, None
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        n += r["count"]
        if n > KNOWN_WORDS:
            break
        least = r["size"]
    best = words.where(size >= least).select("word", "kind", "count").toPandas() if least is not None else pd.DataFrame({"word": [], "kind": [], "count": []})
    total, distinct = sum(x for x, _ in by_kind.values()) + ends, sum(x for _, x in by_kind.values()) + (ends > 0)
    return Vocabulary(best["word"].to_numpy(np.int64).view(np.uint64), best["kind"].to_numpy(np.int64), best["count"].to_numpy(np.int64), ends, total, distinct, by_kind)


def trained(docs: DataFrame, vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds of training in streams and averaging; each document is in one round and one stream."""
    sc = docs.sparkSession.sparkContext
    place = F.xxhash64(F.lit("train"), "doc_id", "text")
    streams = max(1, round(vocabulary.value.total / rounds / STREAM_TOKENS))
    pick = lambda shift, n: F.pmod(F.shiftright(place, shift), F.lit(n)).cast("int")
    parts = docs.select("text", pick(8, rounds).alias("round"), F.pmod(F.xxhash64(F.lit("stream"), place), F.lit(streams)).cast("int").alias("stream"), place.alias("place"))
    parts = checkpointed(parts.mapInArrow(_sequences(vocabulary), "round int, stream int, place bigint, codes array<smallint>"))
    flat = Model(vocabulary.value).flat
    for k in range(rounds):
        weights = sc.broadcast(flat)
        run = _train(vocabulary, weights, RATE * (1 - 0.8 * k / rounds), WIDE if k else LANES)
        own = parts.where(F.col("round") == k).drop("round").repartitionById(streams, "stream").sortWithinPartitions("stream", "place", "codes")
        sums = array_sums(own.drop("place").mapInArrow(run, "place int, sums array<double>"), "place", "sums").toPandas().sort_values("place")
        if len(sums):
            total = np.concatenate(sums["sums"].tolist())
            flat = (total[:-1] / total[-1]).astype(np.float32)
    return flat


def lm_scores(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Scores of all rows of docs (doc_id, text), learned from `train` (doc_id, text).

    doc_id, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score (log10 by smoothed
    counts), score (log10 by the model). A null or empty text is its end alone. Rows are scored each by its own text,
    also where ids repeat or are null. With nothing to train on, words unseen get what smoothing leaves.
    """
    counts = train.select("text").mapInArrow(_count, "word long, kind int, count long")
    counts = checkpointed(counts.groupBy("word", "kind").agg(F.sum("count").alias("count")).where("count > 0"))
    v = vocabulary_of(counts)
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(v)
    weights = sc.broadcast(trained(train, vocabulary))
    columns = "doc_id long, n_tokens long, known long, base double, score double, words array<long>, times array<int>, kinds array<short>"
    scored = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(vocabulary, weights), columns).withColumn("row_id", F.monotonically_increasing_id()))
    rare = scored.select("row_id", F.explode(F.arrays_zip("words", "times", "kinds")).alias("r")).select("row_id", F.col("r.words").alias("word"), F.col("r.times").alias("times"), F.col("r.kinds").cast("int").alias("kind"))
    rare = rare.join(counts.select("word", "kind", "count"), ["word", "kind"], "left")
    count = F.coalesce("count", F.lit(0)) + SMOOTH
    total = F.element_at(F.array(*[F.lit(float(x)) for x in v.kind_total + SMOOTH * (v.kind_distinct + 1)]), F.col("kind") + 1)
    rare = rare.groupBy("row_id").agg(
        F.sum(F.when(F.col("count").isNotNull(), F.col("times"))).alias("more"),
        F.sum(F.col("times") * F.log10(count / (v.total + SMOOTH * (v.distinct + 1)))).alias("base_more"),
        F.sum(F.col("times") * F.log10(count / total)).alias("score_more"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("words", "times", "kinds").join(rare, "row_id", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"), (F.col("score") + zero("score_more")).alias("score"),
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    # a row without an id is scored, never learned from
    out = lm_scores(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
