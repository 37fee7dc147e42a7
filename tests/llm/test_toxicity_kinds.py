"""Toxicity with few kinds of toxic texts, and texts without any known term."""

import random

import pytest

from claimloom.llm import toxicity


def rows_of(kinds, seed=1):
    """400 labelled rows, 100 of them toxic, from so many toxic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(3, 8)))
    plain = [word() for _ in range(400)]
    toxic = [" ".join(rng.sample(plain, 20) + [f"vile{k}", f"nasty{k}", f"hateful{k}"]) for k in range(kinds)]
    texts = [toxic[n % kinds] if n < 100 else " ".join(rng.sample(plain, 20)) for n in range(400)]
    return [(n, t) for n, t in enumerate(texts)], [(n, int(n < 100)) for n in range(400)], toxic


@pytest.mark.parametrize("kinds", [1, 5, 40])
def test_harmless_texts_get_the_base_rate_and_copies_are_found(spark, kinds):
    docs, labels, toxic = rows_of(kinds)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [(0, ""), (1, None), (2, "entirely harmless unknown words"), (3, "!?"), *[(10 + k, t) for k, t in enumerate(toxic)]]
    found = {r.doc_id: r._toxicity for r in toxicity.scored(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for n in range(4):
        assert found[n].score == model.base == 0.25 and found[n].predicted == 0 and found[n].evidence == []
    if kinds < 40:
        for k in range(kinds):
            assert found[10 + k].predicted == 1 and found[10 + k].evidence[0].label == 1
