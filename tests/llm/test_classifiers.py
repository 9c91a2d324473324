"""The two classifiers' scores against plain readings of their definitions, document by document."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from lexloom.llm import quality, toxicity

WORDS = "the quick brown fox jumps over lazy dogs while seven green birds sing songs and rivers run on".split()


def plain_statistics(text):
    """The statistics of one text, one after another."""
    raw = (text or "").encode()
    size = max(1, len(raw))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    lines = [x for x in (text or "").split("\n") if x]
    lowered = [x.translate({c: c + 32 for c in range(65, 91)}) for x in lines]
    sets = {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "line_end": (10,), "beyond_ascii": range(128, 256),
        "sentence": b".!?,;:'\"()-", "markup": b"<>{}[]\\/=_`~^|", "sign": b"#$%&*+@",
    }
    out = [sum(b in kind for b in raw) / size for kind in sets.values()]
    n, m = max(1, len(words)), max(1, len(lines))
    again = sum(a == b for a, b in itertools.pairwise(words))
    letters = sum(len(w.encode()) for w in words)
    return [
        *out, math.log1p(len(raw)), math.log1p(letters / n), len(set(words)) / n, max(Counter(words).values(), default=0) / n, again / n, math.log1p(len(raw) / m), len(set(lowered)) / m,
        sum(len(x.encode()) < 30 for x in lines) / m, sum(x.encode()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / m,
    ]


def plain_isotonic(points):
    """The monotone fit of weighted points (x, ones, n) by the minimax formula, as groups of equal value."""
    value = []
    for i in range(len(points)):
        mean = lambda a, b: sum(p[1] for p in points[a : b + 1]) / sum(p[2] for p in points[a : b + 1])
        value.append(max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)))
    out = []
    for _, own in itertools.groupby(zip(points, value, strict=True), key=lambda z: round(z[1], 12)):
        own = [p for p, _ in own]
        n = sum(p[2] for p in own)
        out.append((sum(p[0] * p[2] for p in own) / n, (sum(p[1] for p in own) + 0.5) / (n + 1)))
    return out


def test_quality_scores_equal_a_plain_reading(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        good = i % 3 > 0
        noise = rng.random() < 0.25
        text = (". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 12))).capitalize() for _ in range(rng.randrange(1, 6))) + ".\n") * rng.randrange(1, 3)
        if good == noise:
            text = " | ".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 40))) + " %% <b>é</b>\n" + text[:40]
        rows.append((i, text))
        labels.append((i, int(good), i % 2))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "A"), (5, rows[6][1])]
    x = np.array([plain_statistics(t) for _, t in rows])
    learn = [i for i, (d, _) in enumerate(rows) if d < 120]
    of = {d: (q, f) for d, q, f in labels}
    q, fold = np.array([of[rows[i][0]][0] for i in learn], float), np.array([of[rows[i][0]][1] for i in learn])
    means, spreads = x[learn].mean(0), x[learn].std(0)
    kernel = quality.Kernel(means, np.where(spreads > 0, spreads, 1.0))
    z = np.array([[*(math.sqrt(2 / len(kernel.b)) * math.cos(np.clip((v - kernel.means) / kernel.spreads, -8, 8) @ kernel.w[:, k] + kernel.b[k]) for k in range(len(kernel.b))), 1.0] for v in x])
    fit = z[learn][fold == 0]
    weights = np.linalg.solve(fit.T @ fit + quality.RIDGE * np.eye(z.shape[1]), fit.T @ q[fold == 0])
    raw = z @ weights
    bins = {}
    for r, y in zip(raw[learn][fold == 1], q[fold == 1], strict=True):
        bins.setdefault(math.floor(min(3.0, max(-2.0, r)) / quality.BIN), []).append((r, y))
    points = [(sum(r for r, _ in own) / len(own), sum(y for _, y in own), len(own)) for _, own in sorted(bins.items())]
    at, p = zip(*plain_isotonic(points), strict=True)
    want = np.interp(raw, at, p)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.quality(docs, spark.createDataFrame([r for r in labels if r[0] < 120], "doc_id long, quality int, fold int")).collect()
    assert len(got) == len(rows)
    pairs = zip(sorted((r.doc_id, r.score) for r in got), sorted((d, w) for (d, _), w in zip(rows, want, strict=True)), strict=True)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in pairs) and want.std() > 0.1


def test_toxicity_scores_equal_a_plain_reading(spark):
    """Votes and features by plain Python, the label model by its probabilities alone, the weights by plain Newton steps."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "zorkul", "zorkan", "zorkem", "d**n", "what?!!"])
        text = " ".join(words)
        rows.append((i, text.upper() if i % 17 == 0 else text + "!!!" * (i % 11 == 0)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (3, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = spark.createDataFrame(labels[:200], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, learn).collect())
    lexicon = toxicity.Lexicon(toxicity.mined_keys(docs, learn))
    assert lexicon.size > sum(len(x.split()) for x in toxicity.INSULTS.values()) - 10 and any(k.startswith("zork") for k in lexicon.at)

    def features(text):
        text = text or ""
        words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.translate({c: c + 32 for c in range(65, 91)}))
        keys = [[k for k in (w, *(w[:n] + "~" for n in toxicity.STEMS if len(w) > n)) if k in lexicon.at] for w in words]
        found = sorted({lexicon.at[k] for own in keys for k in own})
        marked = sum(map(bool, keys))
        share = marked / max(1, len(words))
        dense = share >= toxicity.DENSE_SHARE and marked >= toxicity.DENSE_WORDS
        patterns = [float(text.isupper()), min(1, len(re.findall(r"!{3,}|\?!+", text)) / 3), min(1, len(re.findall(r"\b[A-Za-z]\*{2,}[A-Za-z]*", text)) / 3), float(dense), min(3, 60 * share), math.log1p(marked), math.log1p(len(text)) / 10]
        patterns = [float(np.float32(p)) for p in patterns] if text else [0.0] * 7
        votes = [0] * toxicity.VOTERS
        for f in found:
            votes[lexicon.voter[f]] = 1
        for k in range(4):
            votes[toxicity.VOTERS - 4 + k] = int(patterns[k] > 0)
        x = np.zeros(lexicon.size + 9)
        x[found] = 1
        x[lexicon.size :] = [*patterns, math.log1p(len(found)), 1.0]
        return votes, x

    votes, x = map(np.array, zip(*(features(t) for _, t in rows), strict=True))
    combinations, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(np.mean([y for _, y in labels[:200]])).fit(combinations, counts.astype(float))

    def posterior(v):
        """Bayes' rule over the tree of votes, one factor a voter."""
        joint = []
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for j in range(toxicity.VOTERS):
                rate = model.rate[y, j][v[model.parent[j]] if model.parent[j] >= 0 else 0]
                p *= rate if v[j] else 1 - rate
            joint.append(p)
        return joint[1] / sum(joint)

    y = np.array([posterior(v) for v in votes])
    # at a fixed point of the model its rates are the posteriors' own shares
    for j in (k for k in range(toxicity.VOTERS) if model.parent[k] < 0):
        smooth = (y @ votes[:, j] + 0.5) / (y.sum() + 1)
        assert abs(model.rate[1, j, 0] - (y @ votes[:, j] + 2 * smooth) / (y.sum() + 2)) < 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(toxicity.ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + toxicity.RIDGE * np.eye(len(w)), x.T @ (y - p) - toxicity.RIDGE * w)
        w = w + step
        if np.abs(step).max() < toxicity.CLOSE:
            break
    want = sorted((d, float(s)) for (d, _), s in zip(rows, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True))
    assert [d for d, _ in got] == [d for d, _ in want] and max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-3
    assert np.std([s for _, s in want]) > 0.1
