"""The aligning reranker against enumeration, and on misspelt names."""

import itertools
import random

import numpy as np
import pytest

from orgweave.operators import alignment
from orgweave.providers import lexical_reranker

KINDS = ["University of {}", "Technical University of {}", "{} Institute of Technology", "{} General Hospital", "National Laboratory of {}", "{} Academy of Sciences"]
SYLLABLES = ["ba", "den", "ko", "lin", "mar", "to", "vi", "sen", "gra", "pol", "ne", "rus", "ta", "hel"]


def test_assignment_equals_enumeration():
    r = np.random.default_rng(4)
    for _ in range(150):
        n, m = map(int, r.integers(1, 6, 2))
        gain = np.where(r.random((n, m)) < 0.3, 0.0, r.random((n, m)).round(1))
        pairs = alignment.assign(gain)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(gain[i, j] > 0 for i, j in pairs)
        small, large = (gain, m) if n <= m else (gain.T, n)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), min(n, m)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_similarity_of_words():
    assert alignment.edits("kitten", "sitting") == 3 and alignment.edits("", "ab") == 2
    assert alignment.similarity("univ", "university") == alignment.PREFIX and alignment.similarity("abc", "xyz") == 0
    assert alignment.similarity("physics", "phyiscs") == pytest.approx(1 - 2 / 7)


def misspelt(name, r):
    letters = list(name)
    for _ in range(3):
        i = r.randrange(1, len(letters) - 1)
        if r.random() < 0.5:
            letters[i], letters[i + 1] = letters[i + 1], letters[i]
        else:
            letters[i] = r.choice("aeiou")
    words = "".join(letters).split(" ")
    r.shuffle(words)
    return " ".join(words)


def test_learned_alignment_beats_word_overlap(spark):
    r = random.Random(8)
    names = list(dict.fromkeys(r.choice(KINDS).format("".join(r.choices(SYLLABLES, k=3)).title()) for _ in range(400)))
    asked = [(misspelt(n, r), n, r.sample(names, 9)) for n in r.sample(names, 160)]
    pairs = [(q, right, wrong) for q, right, others in asked[:80] for wrong in others if wrong != right]
    model = alignment.train(spark.createDataFrame([(n,) for n in names] + [(None,)], "text string"), spark.createDataFrame([*pairs, (None, "a", "b")], "query string, right string, wrong string"))
    held = [(q, d) for q, right, others in asked[80:] for d in {right, *others}]
    table = spark.createDataFrame(held, "query string, document string")
    first = []
    for rerank in (model.provider(), lexical_reranker):
        scores = {(x.query, x.document): x.rerank_score for x in rerank(table).collect()}
        assert set(scores) == set(held) and all(0 <= s <= 1 for s in scores.values())
        first.append(np.mean([all(scores[q, right] > scores[q, d] for d in others if d != right) for q, right, others in asked[80:]]))
    assert first[0] > 0.9 and first[0] > first[1]


def test_weights_without_pairs_and_odd_texts(spark):
    names = spark.createDataFrame([("One two",), ("two",)], "text string")
    model = alignment.train(names, spark.createDataFrame([], "query string, right string, wrong string"))
    assert model.weights == alignment.Aligner().weights and model.frequencies == {"two": 2, "one": 1}
    assert model.score("one two", "two one") > model.score("one two", "three") > 0
    got = model.provider()(spark.createDataFrame([(None, "x"), ("", ""), ("a", None), ("w " * 500, "w " * 600)], "query string, document string")).collect()
    assert len(got) == 4 and all(0 <= x.rerank_score <= 1 for x in got)


def test_pairwise_loss_has_no_better_neighbour():
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5)) + 0.4
    w = alignment.fit(x, steps=5_000)
    loss = lambda v: np.mean(np.log1p(np.exp(-(x @ v)))) + 0.5e-3 * v @ v
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in 1e-3 * r.normal(size=(50, 5)))
