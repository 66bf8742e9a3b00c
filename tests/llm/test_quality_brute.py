"""The quality classifier against a plain version: features, log-count ratios, and the hinge loss it should minimise."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import quality


def brute_features(text):
    """Distinct tokens, pairs of tokens, and repeats whatever their wording."""
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall("[0-9a-z\u0080-\U0010ffff]+|[!-/:-@\\[-`{-~]+", fold)
    out = {("one", t) for t in tokens} | {("two", *p) for p in zip(tokens, tokens[1:])}
    for period in (1, 2):
        for times in (2, 3):
            for i in range(len(tokens) - period * times + 1):
                part = tokens[i : i + period * times]
                if part == part[:period] * times:
                    out.add(("again", period, times))
    return out


def own_features(texts, bits):
    got = [set() for _ in texts]
    for i, _, rows, slots in quality.features(pa.array(texts, pa.string()), bits):
        for r, s in zip(rows.tolist(), slots.tolist()):
            got[i + r].add(s)
    return got


def random_texts(rng, n):
    words = ["the", "Of", "é", "x1", "--", "(", "a.b", "zz", "zz zz", " ", "§"] + [f"w{i}" for i in range(40)]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\x7f", "!"]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_features_are_those_of_the_texts():
    texts = [*random_texts(random.Random(1), 200), None, "", " \n", "a a a a", "x y x y x y", "Ab aB"]
    want, got = [brute_features(t) for t in texts], own_features(texts, 40)
    assert [len(x) for x in got] == [len(x) for x in want]
    for k in range(0, len(texts) - 1, 3):
        assert len(got[k] & got[k + 1]) == len(want[k] & want[k + 1])


def brute_margins(sets, y, ratio, others, turns=400, c=1.0):
    """Margins of ``others`` under the minimum of the hinge loss over scaled unit rows, by many turns of coordinate steps."""
    slots = sorted(set().union(*sets))
    place = {s: k for k, s in enumerate(slots)}

    def row(s):
        x = np.zeros(len(slots) + 1)
        for f in s:
            if f in place:
                x[place[f]] = ratio[f]
        norm = math.sqrt(sum(ratio[f] ** 2 for f in s))
        x /= norm if norm > 1e-6 else 1.0
        x[-1] = 1.0  # the bias
        return x

    x, sign = np.array([row(s) for s in sets]), np.where(np.array(y) == 1, 1.0, -1.0)
    upper = [c * len(y) / (2 * max(1, sum(v == u for v in y))) for u in y]
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    for _ in range(turns):
        for i in range(len(y)):
            new = min(max(alpha[i] - (sign[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0.0), upper[i])
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    return [float(w @ row(s)) for s in others]


def test_model_against_the_plain_one(spark):
    rng = random.Random(4)
    good = ["the river " + t + " ran on and on" for t in random_texts(rng, 45)]
    bad = ["## $$ " + t + " buy buy buy" for t in random_texts(rng, 45)]
    texts = good[:40] + bad[:40] + good[40:] + bad[40:] + [None, "", "never seen"]
    y = [1] * 40 + [0] * 40
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1][: len(y)] + list(range(5000, 5000 + len(texts) - len(y)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(zip(ids, y)), "doc_id long, quality int")
    model = quality.learn(docs, labels)
    sets = own_features(texts, quality.BITS)
    n = {c: sum(v == c for v in y) for c in (0, 1)}
    ratio = {}
    for s in set().union(*sets[: len(y)]):
        held = {c: sum(s in f and v == c for f, v in zip(sets, y)) for c in (0, 1)}
        ratio[s] = math.log((held[1] + 1) / (n[1] + 2)) - math.log((held[0] + 1) / (n[0] + 2))
        assert abs(model.ratio[s] - ratio[s]) < 1e-9
    assert np.count_nonzero(model.ratio) <= len(ratio)
    full = {s: ratio.get(s, 0.0) for s in set().union(*sets)}
    margins = brute_margins(sets[: len(y)], y, full, sets)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, margin in zip(ids, margins):
        own = math.log(scores[i] / (1 - scores[i])) / model.slope
        assert abs(own - margin) < 0.1 and ((own >= 0) == (margin >= 0) or abs(margin) < 0.1)
    assert all(scores[i] >= 0.5 for i, u in zip(ids, y) if u == 1) and all(scores[i] < 0.5 for i, u in zip(ids, y) if u == 0)
    assert docs.where(F.col("doc_id") >= 5000).count() == 13
