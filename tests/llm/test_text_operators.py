"""Operators over texts against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from orgweave.llm import bpe, components, decontaminate, linededup, rlz, simhash, toxicity
from orgweave.llm import queries as training
from orgweave.llm.tokens import PATTERN, Encoder, Vocabulary, merge_word, word_splitter

VOCABULARY = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks(), special_tokens={})
SCHEMA = "doc_id long, text string, fp long, word string, n int"


def table(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def random_texts(seed, n, words=120, pool=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(pool)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(0, words))) for _ in range(n)]


# --- byte-level BPE


ODD_TEXTS = [
    None, "", " ", "a", "\n\n  x", "It's we're I'd  CAN'T\t\t", "żółć Ünïcödé 漢字かな 한국어 🙂🙂🙂", "0123456789" * 20, "=" * 300, "aaaaaaaa" * 40, "  " * 150 + "end",
    "\x00\x1f\x85\u2003 x", "lowercase" * 60 + " tail", "\ufeffbom", "e\u0301", "<|endoftext|>",
]


def test_pattern_is_the_vocabularys():
    assert PATTERN == public_tokenizers.PATTERN


def test_both_engines_split_alike():
    slow, split = regex.compile(PATTERN).findall, word_splitter()
    everything = "".join(map(chr, [*range(0x20), *range(0x20, 0x2C2)]))
    for text in [t for t in ODD_TEXTS if t] + [everything, everything[::-1], " ".join(everything), everything[0x20:], " '".join(everything[0x20:])]:
        assert split(text) == slow(text)


def test_bpe_equals_tiktoken(spark, monkeypatch):
    r = random.Random(9)
    texts = [*ODD_TEXTS, *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()], "banana bananana ananas"]
    texts += ["".join(r.choice("abcdeinorst an=é漢") for _ in range(r.randint(0, 300))) for _ in range(100)] + [texts[5], texts[5]]
    for chars, held in ((bpe.CHUNK_CHARS, bpe.DICTIONARY_WORDS), (500, 5)):  # one chunk in a task, and many; words from the dictionary, and folded in their chunk
        monkeypatch.setattr(bpe, "CHUNK_CHARS", chars)
        monkeypatch.setattr(bpe, "DICTIONARY_WORDS", held)
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, texts).repartition(3), VOCABULARY), VOCABULARY).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = REFERENCE.encode_ordinary(t or "")
            assert got[i].n_tokens == len(ids), (i, t)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert bytes(got[i].decoded) == (t or "").encode()


def test_bpe_of_very_long_words_and_rows_without_an_id(spark):
    r = random.Random(10)
    texts = ["a" * 200_000, "=-" * 20_000, "".join(r.choice("etaoinshrdlu") for _ in range(3000)), " " * 9000, "again", "again"]
    got = bpe.decode(bpe.encode(table(spark, texts, [1, 2, 3, None, None, 3]), VOCABULARY), VOCABULARY).collect()
    want = sorted((merge_word_ids(t), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted((row.n_tokens, row.decoded_sha256) for row in got) == want
    assert sorted((row.doc_id or 0) for row in got) == [0, 0, 1, 2, 3, 3]


def merge_word_ids(text):
    return sum(len(merge_word(w.encode(), VOCABULARY.ranks())) for w in word_splitter()(text))


def test_bpe_of_pieces_looked_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    texts = ["one two three four five six seven eight nine ten eleven", "one two three four five six seven", None]
    for row in bpe.decode(bpe.encode(table(spark, texts), VOCABULARY), VOCABULARY).collect():
        ids = REFERENCE.encode_ordinary(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256, bytes(row.decoded)) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), (texts[row.doc_id] or "").encode())


def test_bpe_of_no_rows(spark):
    assert bpe.decode(bpe.encode(table(spark, ["x"]).where("false"), VOCABULARY), VOCABULARY).count() == 0


def test_merge_word_equals_tiktoken():
    ranks, r = VOCABULARY.ranks(), random.Random(3)
    for _ in range(2000):
        word = bytes(r.choice(b"abcdeinorst \xc3\xa9=") for _ in range(r.randint(1, 40)))
        assert merge_word(word, ranks) == REFERENCE._core_bpe.encode_single_piece(word)
    assert b"".join(VOCABULARY.pieces[i] for i in merge_word(b"ab" * 20000, ranks)) == b"ab" * 20000


def test_every_piece_encodes_to_itself():
    """So merging by rank is the same whichever occurrence of a pair goes first."""
    encoder = Encoder(VOCABULARY)
    assert all(encoder.ranks[p] == i for i, p in enumerate(VOCABULARY.pieces))


# --- SimHash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def near_texts():
    r, texts = random.Random(5), random_texts(11, 60)
    for t in list(texts[:25]):
        words = t.split()
        for _ in range(3):
            if len(words) > 60:
                w = list(words)
                w[r.randrange(len(w))] = "zz"
                texts.append(" ".join(w))
    return [*texts, *texts[:10], "", None, "  \n", "One Two", "one two", "ONE", "a\x0bb c"]


def test_simhash_equals_brute_force(spark):
    texts = near_texts()
    fps = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = brute_components(range(len(texts)), links)
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == root[i], i
    kept = simhash.keep_one(table(spark, texts))
    assert kept.columns == table(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == set(root.values())


def test_ball_finds_all_within_radius(spark):
    r, values = random.Random(8), []
    for _ in range(40):
        base = r.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 2, 3, 3, 3, 4, 5)]
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    df = spark.createDataFrame([(v, v) for v in signed], "fp long, grp long")
    got = {(r.a, r.b) for r in simhash._ball_links(df).collect()}
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(5, 5), (2, 1), (None, 3), (50, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 30)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup


def brute_spans(rows):
    words = {i: [w for w in rlz.words_of(t)] for i, t in rows}
    first = {}
    for i, ws in words.items():
        for p in range(len(ws) - rlz.WINDOW + 1):
            k = tuple(ws[p : p + rlz.WINDOW])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for p in range(len(ws) - rlz.WINDOW + 1):
            if first[tuple(ws[p : p + rlz.WINDOW])] < i:
                gone.update(range(p, p + rlz.WINDOW))
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def passage_texts():
    r, texts = random.Random(21), random_texts(22, 30, words=400)
    passages = [" ".join(random_texts(s, 1, words=1)[0] or f"p{s}w{i}" for i in range(n)) for s, n in ((1, 49), (2, 50), (3, 51), (4, 80), (5, 200))]
    for _ in range(40):
        t = texts[r.randrange(30)].split()
        at = r.randrange(len(t) + 1)
        p = r.choice(passages).split()
        cut = r.randrange(0, 3)
        texts.append(" ".join([*t[:at], *p[cut:], *t[at:]]))
    loop = " ".join(["again", "and"] * 90)
    texts += [loop, loop + " again", " ".join(["same"] * 130), " ".join(["same"] * 51), texts[0], texts[0], None, "", "short one", "tab\tsep\x0bx"]
    # two earlier sources for the two halves of one stretch
    halves = [f"h{i}" for i in range(120)]
    texts += [" ".join(halves[:75]), " ".join(halves[45:]), " ".join(halves), " ".join(halves + ["x"] + halves[:60])]
    return texts


def test_substring_dedup_equals_brute_force(spark):
    texts = passage_texts()
    got = {r.doc_id: r for r in rlz.remove_duplicate_spans(table(spark, texts).repartition(5)).collect()}
    want = brute_spans(list(enumerate(texts)))
    assert len(got) == len(texts)
    for i in want:
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == want[i], i
        assert hashlib.sha256(got[i].kept.encode()).hexdigest() == want[i][2]
    assert sum(w[1] > 0 for w in want.values()) > 30


def test_substring_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = table(spark, [long, long, long, None], [3, None, 3, 4])
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rlz.remove_duplicate_spans(rows, with_text=False).collect())
    assert got == [(-1, 60, 0), (3, 60, 0), (3, 60, 0), (4, 0, 0)]
    assert rlz.remove_duplicate_spans(rows.where("false")).count() == 0


# --- line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            k = tuple(lines[p : p + 3])
            if k in seen:
                gone.update((p, p + 1, p + 2))
            seen.add(k)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(9)
    texts = ["\n".join(r.choice(["a", "b", "", "c d", "x" * 50]) for _ in range(r.randint(1, 14))) for _ in range(80)]
    texts += ["a\nb", "", "\n\n\n\n", "one\ntwo\nthree", "one\ntwo\nthree\nfour", "one\ntwo\nthree"]
    out = linededup.remove_repeated_lines(table(spark, texts).repartition(3))
    got = {x.doc_id: x for x in out.collect()}
    want = brute_lines(list(enumerate(texts)))
    for i, (text, n) in want.items():
        assert (got[i].text, got[i].n_removed) == (text, n), i


def test_line_dedup_of_odd_rows(spark):
    rows = table(spark, ["a\nb\nc", "a\nb\nc", None, "a\nb\nc"], [1, None, 2, 3]).withColumn("n_lines", F.lit(99)).withColumn("k1", F.lit("k"))
    got = {x.doc_id: x for x in linededup.remove_repeated_lines(rows).collect()}
    assert got[1].text == "a\nb\nc" and got[None].text == "a\nb\nc" and got[2].text is None and got[3].text == "" and got[3].n_lines == 3
    assert got[2].n_lines == 0 and got[3].k1 == "k"
    assert linededup.remove_repeated_lines(rows.where("false")).count() == 0


# --- decontamination


def brute_leaks(docs, items):
    def words(t):
        return [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    out = {}
    for d, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            if not w or not v or (len(v) < 5 <= len(w)):  # an item of fewer words than a shingle is found only as a whole document
                continue
            a, best = shingles(v), None
            for s in range(max(1, len(w) - len(v) + 1)):
                b = shingles(w[s : s + len(v)])
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if best is None or sim > best:
                    best = sim
            if best >= decontaminate.SIMILARITY:
                out[d, item] = round(best, 6)
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(31)
    items = [" ".join(f"i{k}w{r.randrange(900)}" for _ in range(n)) for k, n in enumerate((3, 5, 6, 20, 20, 40, 55))]
    docs = random_texts(32, 20)
    for k, item in enumerate(items * 6):
        w = item.split()
        for _ in range(k % 4):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + 1] = [["zz"], [], [w[at], "yy"]][kind]
        host = docs[k % 20].split()
        at = r.randrange(len(host) + 1)
        docs.append(" ".join([*host[:at], *w, *host[at:]]))
    docs += [items[5].upper() + "!", ", ".join(items[6].split()), items[5][: len(items[5]) * 9 // 10], None, "", "...", items[0], " ".join([items[3]] * 3)]
    items_df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*items, items[0], None, "--"])] + [(None, items[0], "x", 1)], "item_id long, text string, h string, len int")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_leaks(table(spark, docs), items_df).collect()}
    want = brute_leaks(list(enumerate(docs)), list(enumerate([*items, items[0]])))
    assert got == pytest.approx(want)
    monkeypatch.setattr(decontaminate, "LITERAL_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    joined = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_leaks(table(spark, docs), items_df).collect()}
    assert joined == got
    monkeypatch.undo()
    kept = decontaminate.remove_leaks(table(spark, docs), items_df)
    assert kept.columns == table(spark, docs).columns
    assert {x.doc_id for x in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert decontaminate.find_leaks(table(spark, docs), items_df.where("false")).count() == 0
    assert decontaminate.find_leaks(table(spark, docs).where("false"), items_df).count() == 0


def test_block_values_of_many_items_are_not_broadcast(spark):
    r = random.Random(37)
    items = [" ".join(f"i{k}w{r.randrange(900)}" for _ in range(8 + k % 3)) for k in range(60)]
    # one passage in many texts: its windows share a fingerprint
    docs = [f"d{k} e{k} {items[k % 60]} f{k}" for k in range(80)] + [f"x{k} {items[7]}" for k in range(40)]
    found = decontaminate.find_leaks(table(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "value#" in x]
    # 60 items have 167,280 block values, which the driver would have to hold for a broadcast
    assert joins and all("strategy=merge" in x for x in joins)
    got = {(x.doc_id, x.item_id): x.similarity for x in found.collect()}
    assert got == pytest.approx(brute_leaks(list(enumerate(docs)), list(enumerate(items))))


def test_short_items_within_longer_texts(spark, monkeypatch):
    items = ["yes", "one two", "Red, green blue!", "a b c d", "a b c d e", "nowhere at all"]
    docs = ["yes", "he said YES and yes", "yesterday one", "x one two y one two", "red green blue", "so red green blue it was", "a b c d", "z a b c d e z", "a b c", None, ""]
    items_df = spark.createDataFrame(list(enumerate([*items, items[1], None])), "item_id long, text string")

    def brute():
        clean = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        for d, text in enumerate(docs):
            for i, item in enumerate([*items, items[1]]):
                w, v = clean(text), clean(item)
                at = [s for s in range(len(w) - len(v) + 1) if w[s : s + len(v)] == v]
                if at:
                    yield d, i, at[0], len(v), 1.0

    want = sorted(brute())
    assert len(want) == 9
    found = lambda: sorted(tuple(x) for x in decontaminate.find_leaks(table(spark, docs), items_df, short_items=True).collect())
    assert found() == want
    kept = decontaminate.remove_leaks(table(spark, docs), items_df, short_items=True)
    assert {x.doc_id for x in kept.collect()} == set(range(len(docs))) - {d for d, *_ in want}
    monkeypatch.setattr(decontaminate, "LITERAL_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert found() == want


# --- toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = training.op9_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    toxic, called = sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    assert toxic > 50
    # with so few labelled rows some labels mark texts that hold no telling word, and the words of much-copied texts look telling
    assert hit / toxic >= 0.85 and hit / max(called, 1) >= 0.75
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark):
    texts = [f"kind a{i} words b{i} here" for i in range(200)] + [f"rotten a{i} words b{i} here" for i in range(200, 240)] + [None, "", "rotten"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(200, 240)] + [(0, 0), (1, None), (None, 1), (999, 1), (200, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, prior=0.2)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[242] > by[241] == by[240]
    untaught = toxicity.train(docs, labels.where("false"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, untaught).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.remove_toxic(docs, labels).columns == docs.columns


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_toxicity_where_much_is_toxic(spark, share):
    rng = random.Random(3)
    telling = [f"vile{i}y" for i in range(40)]
    texts, toxic = [], []
    for _ in range(3000):
        toxic.append(int(rng.random() < share))
        texts.append(" ".join([f"word{rng.randrange(3000)}x" for _ in range(40)] + rng.sample(telling, 4) * toxic[-1]))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2], "doc_id long, toxic int")
    docs = table(spark, texts)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").collect()
    hit = sum(r.predicted == 1 and toxic[r.doc_id] == 1 for r in rows)
    assert hit >= 0.9 * sum(toxic[r.doc_id] for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    got = {r.doc_id: r.h for r in table(spark, [""] * 40).select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(40)}
