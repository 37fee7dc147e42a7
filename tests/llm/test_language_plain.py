"""Language identification against a plain-Python version of the same codes, classifiers and decoding."""

import math
import random

import pytest

from claimloom.llm import language

MASK = (1 << 32) - 1


def slots(text):
    """The slot of every 1- to 3-gram, one code point after the other."""
    points = [ord(c) for c in text.lower()]
    for at in range(len(points)):
        h = 0
        for order in range(3):
            if at + order >= len(points):
                break
            h = (h * 0x01000193 + points[at + order] * 0x9E3779B1 + order + 1) & MASK
            mixed = ((h ^ (h >> 15)) * 0x85EBCA6B) & MASK
            yield mixed >> 19


def shares(texts):
    counts = {}
    for text in texts:
        for slot in slots(text):
            counts[slot] = counts.get(slot, 0) + 1
    total = max(1, sum(counts.values()))
    return {slot: n / total for slot, n in counts.items()}


def plain(train, asked, smoothing=1e-6):
    names = sorted({lang for lang, _ in train})
    profile = {name: shares([t for lang, t in train if lang == name]) for name in names}
    splits = range(1, 1 << (len(names) - 1))
    every = {s for p in profile.values() for s in p}
    classifiers = []
    for split in splits:
        one = [n for k, n in enumerate(names) if split >> k & 1]
        other = [n for n in names if n not in one]

        def mean(side, slot):
            return sum(profile[n].get(slot, 0.0) for n in side) / len(side)

        weight = {s: math.log((mean(one, s) + smoothing) / (mean(other, s) + smoothing)) for s in every}

        def side_of(histogram, weight=weight):
            return sum(x * weight.get(s, 0.0) for s, x in histogram.items())

        low, high = min(side_of(profile[n]) for n in one), max(side_of(profile[n]) for n in other)
        classifiers.append((side_of, (low + high) / 2, max((low - high) / 2, 1e-6), one))
    votes = sum(half for _, _, half, _ in classifiers)
    out = []
    for text in asked:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        histogram = shares([text])
        losses = {name: 0.0 for name in names}
        for side_of, middle, half, one in classifiers:
            margin = max(-3.0, min(3.0, (side_of(histogram) - middle) / half))
            for name in names:
                sign = 1 if name in one else -1
                losses[name] += math.log1p(math.exp(-2 * margin * sign)) * half / votes
        best = min(names, key=lambda n: (losses[n], n))
        out.append((best, 1.0 / sum(math.exp(-8 * (losses[n] - losses[best])) for n in names)))
    return out


def test_predictions_equal_the_plain_version(spark):
    rng = random.Random(7)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "xyzabñ", "dd": "абвгab"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7)))
    train = [(lang, " ".join(word(lang) for _ in range(rng.randint(3, 30)))) for lang in letters for _ in range(12)]
    asked = [" ".join(word(rng.choice(list(letters))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    asked += ["", None, "123 !?", "a", "É", "xyz" * 4000]
    frame = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = language.fit(frame)
    found = language.identified(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(found, plain(train, asked), strict=True):
        assert r.lang_pred == lang, asked[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9)
