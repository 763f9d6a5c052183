"""The whole pipeline against slow forms of its five stages, and the toxicity model against a slow form of its choices."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from test_text_operators import brute_components, brute_fingerprint, brute_lines

import corpus_pipeline
from orgweave.llm import decontaminate, toxicity
from orgweave.llm.tokens import Vocabulary


def slow_features(text):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return words | {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}


def slow_model(docs, labels):
    """What `toxicity.train` chooses from a table below its bounds: features, prior, and the weights that the (separately tested) fit gives them."""
    free = [(i, t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), toxic)
    prior = min(0.9, max(0.001, sum(known.values()) / len(known)))
    sample = {}
    for i, t in sorted(free):
        w = (t or "").encode().split()
        sketch = min((xxhash.xxh64_intdigest(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0) >> 1
        for kind in ([1] if known.get(i) == 1 else []) + [0]:
            sample.setdefault((kind, sketch), slow_features(t))
    pos, unl = ([f for (kind, _), f in sample.items() if kind == k] for k in (1, 0))
    count = [Counter(x for f in part for x in f) for part in (pos, unl)]
    ratio = len(pos) / len(unl)
    clear = []
    for x, p in count[0].items():
        expected = count[1][x] * ratio
        z = (p - expected) / np.sqrt(expected + 0.5)
        if p >= min(5, max(2, len(pos) // 4)) and z >= 4:
            clear.append((-z, x, p, count[1][x], expected))
    clear.sort()
    peak = min((min(0.9, (u + 1) * ratio / p) for _, _, p, u, _ in clear[:20]), default=prior)
    names = [x for _, x, p, _, expected in clear if p >= 6 / (1 - peak + 6 * peak) * expected]
    rows = [[sorted(names.index(x) for x in f if x in names) for f in part] for part in (pos, unl)]
    seen = [np.mean([bool(r) for r in part]) for part in rows]
    prior = float(np.clip(1.1 * seen[1] / max(seen[0], 1e-9), 0.7 * min(prior, peak), 1.3 * max(prior, peak)))
    weights, bias = toxicity.fit_nnpu(*[[np.array(r, np.int64) for r in sorted(part)] for part in rows], max(1, len(names)), prior)
    return dict(zip(names, weights[: len(names)], strict=True)), bias, prior


def slow_score(model, text):
    return 1 / (1 + np.exp(-np.clip(model[1] + sum(model[0].get(x, 0.0) for x in slow_features(text)), -40, 40)))


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def slow_leaks(docs, items):
    """Ids of documents with a window of an item's length that is similar to it by weighted shingles; a short item as it stands."""
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    out = set()
    for d, text in docs:
        w = words_of(text)
        mine = set(cut(w)) if w else set()
        for item in items:
            v = words_of(item)
            if not v or not w:
                continue
            if len(v) < 5:
                if any(w[s : s + len(v)] == v for s in range(len(w) - len(v) + 1)):
                    out.add(d)
                continue
            a = Counter(cut(v))
            if mine & set(a):
                for s in range(max(1, len(w) - len(v) + 1)):
                    b = Counter(cut(w[s : s + len(v)]))
                    both = sum((a & b).values())
                    if both / (sum(a.values()) + sum(b.values()) - both) >= decontaminate.SIMILARITY:
                        out.add(d)
                        break
    return out


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest tables have too few toxic texts to learn from


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    rows = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]
    return rows("documents", "doc_id", "text"), rows("labels", "doc_id", "toxic"), [t for _, t in rows("benchmark", "item_id", "text")]


@pytest.fixture(scope="module")
def model(given):
    return slow_model(given[0], given[1])


def test_toxicity_model_equals_its_slow_form(spark, sf_dir, given, model):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    fitted = toxicity.train(docs, labels)
    assert len(model[0]) >= 10
    assert fitted.prior == pytest.approx(model[2]) and fitted.bias == pytest.approx(model[1], abs=1e-6)
    assert fitted.weights == pytest.approx(model[0], abs=1e-6)
    got = {r.doc_id: r.score for r in toxicity.score(docs, fitted).collect()}
    assert got == pytest.approx({i: slow_score(model, t) for i, t in given[0]}, abs=1e-6)


def test_pipeline_equals_its_slow_stages(spark, sf_dir, given, model):
    docs, _, items = given
    kept = [(i, t) for i, t in docs if slow_score(model, t) < toxicity.THRESHOLD]
    lines = brute_lines([(i, t) for i, t in kept if t is not None])
    kept = [(i, lines[i][0] if t is not None else None) for i, t in kept]
    prints = {i: brute_fingerprint(t) for i, t in kept}
    ids = sorted(prints)
    near = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = [(i, t) for i, t in kept if near[i] == i]
    gone = slow_leaks(kept, items)
    kept = [(i, t) for i, t in kept if i not in gone]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks(), special_tokens={})
    expected = set()
    for i, t in kept:
        ids = encoding.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert 0 < len(expected) < len(docs) and gone
    got = corpus_pipeline.run(spark, sf_dir)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == expected
