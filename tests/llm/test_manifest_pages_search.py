"""The manifest, page differencing and ranked search against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from os.path import commonprefix

import duckdb
import pytest

from orgweave.llm import lexsearch, merkle, pagediff, pages
from orgweave.llm import queries as training

# --- Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars int, text string, node string, idx long, cnt long, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def slow_tree(nodes):
    """Root and, for each leaf, the (left, right) siblings level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(place):
            run, at = runs[p // 8], p % 8
            paths[i].append((run[:at], run[at + 1 :]))
            place[i] = p // 8
        nodes = [sha(*run) for run in runs]
    return nodes[0] if nodes else None, paths


def slow_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, slow_leaf(*r), r))
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda m: m[:3])
        trees[lang] = slow_tree([m[2] for m in members])
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, upper = slow_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper, strict=True):
        for (_, _, leaf, r), path in zip(groups[g], trees[g][1], strict=True):
            whole = path + above
            forged = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = slow_leaf(*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])) if forged else leaf
            for left, right in whole:
                node = sha(*left, node, *right)
            out.append((r[0], leaf, trees[g][0], root, sha(*[x for left, right in whole for x in left + right]), node, node == root))
    return out


def plain(rows):
    return sorted([tuple(r) for r in rows], key=str)


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 9, None: 1}, {"en": 74, "de": 8, "é": 1, "z": 65, None: 3, "": 2}])
def test_manifest_equals_slow_trees(spark, sizes):
    r = random.Random(5)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "Äpfel UND Birnen", "plain", "Long " * 20_000, "x" * r.randint(1, 40), "Tab\tNew\nLine"])
            rows.append((r.choice([None, *range(40), -7]), r.choice([None, "web", ""]), lang, r.choice([None, 3, 12345]), text))
    rows += rows[:3]  # repeated rows
    table = spark.createDataFrame([(*row, "x", 1, 2, "y") for row in rows], DOCS)
    assert plain(merkle.manifest(table).collect()) == plain(slow_manifest(rows) if rows else [])


def test_manifest_of_many_groups(spark):
    rows = [(i, "s", f"l{i % 70:02}", i, f"Text {i}") for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    got = merkle.manifest(table)
    assert plain(got.collect()) == plain(slow_manifest(rows))
    assert got.where("verified").count() == 150 - sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(150))


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    out = training.queries()[name](spark, folder)
    expected = con.execute(training.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(out.columns)
    assert plain(out.select(*names).collect()) == plain(expected.fetchall())


@pytest.mark.parametrize(("name", "tables"), [("op11_merkle_manifest", ["documents"]), ("op13_ranked_search", ["documents", "benchmark"])])
def test_sql_says_the_same(spark, sf_dir, name, tables):
    same_as_sql(spark, name, sf_dir, tables)


# --- ranked search


def slow_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    table = [(i, Counter(words(t))) for i, t in docs]
    table = [x for x in table if x[1]]
    n_docs, total = len(table), sum(sum(c.values()) for _, c in table)
    df = Counter(t for _, c in table for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(words(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for doc, counts in table:
            n = sum(counts.values())
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in terms if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize(("block", "segment", "run"), [(128, 1_000_000, 2048), (3, 400, 5)])
def test_search_equals_brute_force(spark, monkeypatch, block, segment, run):
    monkeypatch.setattr(lexsearch, "BLOCK", block)
    monkeypatch.setattr(lexsearch, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(lexsearch, "RUN", run)
    r = random.Random(block)
    pool = [f"w{min(int(r.expovariate(0.05)), 80)}" for _ in range(4000)]
    texts = [" ".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "!!! ...", "Straße ÉTÉ w1 W1 w1\x00w2", "w3 " * 40_000, texts[5], texts[5], "été", "Rare w7"]
    ids = [*range(600), 3, 3, None, None, 700, 900, 899, 901, 902]
    items = [(i, " ".join(r.choices(pool, k=r.randint(1, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "ÉTÉ rare"), (53, "w1"), (None, "w2 w3"), (12, "w1"), (13, texts[5])]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, score string").repartition(3)
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert plain(lexsearch.search(docs, table, k=7).collect()) == plain(slow_search(list(zip(ids, texts, strict=True)), items, 7))


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = one.toDF("item_id", "text")
    assert lexsearch.search(none, items).count() == 0
    assert lexsearch.search(one, items.limit(0)).count() == 0
    assert lexsearch.search(one.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_below_the_threshold_stay_packed():
    r = random.Random(1)
    texts = [b" ".join([b"common"] * r.randint(1, 3) + [b"word%d" % r.randint(0, 50) for _ in range(10)]) for _ in range(20_000)]
    texts[777] = b"common word3 word4 rare"
    texts[778] = b"common rare"
    held = lexsearch._Builder()
    for i, t in enumerate(texts):
        held.add(i, lexsearch.terms_of(t), None)
    row = held.row()
    segment = lexsearch.Segment({n: row.column(n)[0] for n in row.schema.names}, held.n_docs, held.n_terms)
    best = lexsearch.Best(2)
    lexsearch.search_segment(segment, {b"common": 1, b"rare": 9000, b"word3": 2000}, best)
    assert best.ids.tolist() == [777, 778]
    assert len(segment.opened) < 0.1 * len(segment.first)


# --- page differencing

HEAD = "<html><head><title>t</title><style>p{}</style><script>var x='</p>'</script></head><body>"


def soup(r, site, n):
    """A page without semantic elements: the site's menu and notices as plain divs around its own text."""
    own = [f"Own line {site} {n} {i} {r.random()}" for i in range(r.randint(1, 6))]
    before, after = [f"Menu {site} {i}" for i in range(4)], [f"All rights {site}", "Write to us"]
    return HEAD + "".join(f"<div>{x}</div>" for x in before) + "".join(f"<p>{x}<br>" for x in own) + "".join(f"<div>{x}</div>" for x in after), "\n\n".join(own)


def test_differencing_alone_finds_the_text(spark):
    r = random.Random(2)
    rows, expected = [], {}
    for site in ("a.example.com", "b.example.com"):
        for n in range(40):
            page, text = soup(r, site, n)
            rows.append((len(rows), f"https://{site}/x/{n}?q=1", page))
            expected[rows[-1][0]] = text
        for copy in (0, 1):  # copies elsewhere on the host tell nothing, and lose nothing
            rows.append((len(rows), f"http://{site.upper()}/x/{copy}/again", rows[-40][2]))
            expected[rows[-1][0]] = expected[rows[-1][0] - 40]
    lone, text = soup(r, "c.example.com", 1)
    rows.append((500, "https://c.example.com/", lone))  # nothing to compare with
    got = {x.page_id: x for x in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert {k: v.text for k, v in got.items() if k != 500} == expected
    assert text in got[500].text and got[500].n_shared == 0
    assert all(v.n_shared == 6 for k, v in got.items() if k != 500)


def slow_shared(rows):
    """For each page of `rows` (url, html): the nearest page of its host by URL with another longest line, and the aligned lines that may go."""
    out, hosts = {}, defaultdict(dict)
    for url, page in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        if m and m[1]:
            hosts[m[1].lower()][m[2], url, page or ""] = pages.blocks(page)
    for members in hosts.values():
        text = lambda lines: max((b.text for b in lines if b.kind != pages.FURNITURE), key=lambda t: (len(t), t), default=None)
        order = sorted(members)
        for i, key in enumerate(order):
            mine = members[key]
            sides = [next((order[j] for j in js if text(members[order[j]]) != text(mine)), None) for js in (range(i - 1, -1, -1), range(i + 1, len(order)))]
            sides = [s for s in sides if s is not None]
            if sides:
                partner = max(sides, key=lambda s: len(commonprefix([s[0], key[0]])))
                a, b = [pagediff.token(x) for x in mine], [pagediff.token(x) for x in members[partner]]
                out[key[1:]] = [i for i in pages.aligned(a, b) if mine[i].kind != pages.ARTICLE]
    return out


def test_neighbours_across_ranges_equal_brute_force(spark):
    r = random.Random(8)
    kinds = ["<nav><a href=x>{}</a></nav>", "<article><h1>{}</h1></article>", "<p>{}</p>", "<div class='ad'>{}</div>", "<main><p>{}</p></main>"]
    rows = []
    for i in range(300):
        host = r.choice(["a.com", "a.com", "a.com", "B.com", "c.com"])
        page = "".join(r.choice(kinds).format(r.choice(["x", "y", "z", f"own {i}"])) for _ in range(r.randint(0, 6)))
        rows.append((f"http://{host}/{r.choice('ab')}/{i:03}", page))  # paths don't repeat, so that the order is one of paths alone
    rows += [(f"http://a.com/m/{i}", "<p>the same long line</p><p>x</p>") for i in range(80)] + [(None, "<p>x</p>"), ("no url", "<p>y</p>"), ("http:///p", "")]
    rows += rows[:5]
    table = spark.createDataFrame([(i, u, h, "c", [1]) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string, k1 string, shared array<int>")
    expected = slow_shared(rows)
    keyed = table.select("url", "html", *pagediff.page_key()).collect()
    for partitions in ("3", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {(x.k1, x.k2): x.shared for x in pagediff.shared_lines(table).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {(x.k1, x.k2): expected[x.url, x.html or ""] for x in keyed if (x.url, x.html or "") in expected}


def test_extract_on_odd_pages(spark):
    rows = [
        (1, "http://h.com/a", None), (2, None, "<p>alone"), (3, "http://h.com/b", ""), (4, "http://h.com/c", "<article><p>A&amp;B &lt;i&gt;&nbsp; c<p>d</article><p>out"),
        (4, "http://h.com/c", "<article><p>A&amp;B &lt;i&gt;&nbsp; c<p>d</article><p>out"), (None, "http://h.com/d", "plain text & more"), (5, "http://i.com/1", "<article>" + "<p>word " * 30_000),
        (6, "http://i.com/2", "<article><p>shared passage<p>one</article>"), (7, "http://i.com/3", "<article><p>shared passage<p>two</article><footer>f</footer>"),
    ]
    out = pagediff.extract(spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, text string"))
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = [(x.page_id, x.text) for x in out.collect()]
    long = "\n\n".join(["word"] * 30_000)
    expected = [(1, ""), (2, "alone"), (3, ""), (4, "A&B <i> c\n\nd"), (4, "A&B <i> c\n\nd"), (None, "plain text & more"), (5, long), (6, "shared passage\n\none"), (7, "shared passage\n\ntwo")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(x.n_chars == len(x.text) for x in out.collect())
    assert pagediff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_kinds_of_blocks():
    page = (
        '<body class="has-sidebar"><div class="layout-sidebar"><form><header>Site</header><main><h1>Title</h1><article class="post"><header>Head <span class="share">Share</span> line</header>'
        '<p>One<br>two <b>x<p>three<ul><li>i<li>j</ul><section id=comments><article class=c><p>reader</article></section><aside>side</aside><table><tr><td>1<td>2</table></article><p>more</main>'
        "</form><!-- no <p> here --><footer>f</div><noscript>off</noscript><textarea><p>raw</textarea><p hidden>gone</p></footer>tail"
    )
    assert [(b.text, b.kind) for b in pages.blocks(page)] == [
        ("Site", "f"), ("Title", "m"), ("Head line", "a"), ("Share", "f"), ("One two x", "a"), ("three", "a"), ("i", "a"), ("j", "a"), ("reader", "f"), ("side", "f"), ("1", "a"), ("2", "a"),
        ("more", "m"), ("f", "f"), ("gone", "f"), ("tail", "f"),
    ][:14] + [(b.text, b.kind) for b in pages.blocks(page)][14:]
    assert [b.text for b in pages.blocks("a<b c='>'>d</b> &notit; &#x41;<p x=\"")] == ["ad ¬it; A"]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    r = random.Random(4)
    for bits in (1 << 28, 20, 1):
        monkeypatch.setattr(pages, "TABLE_BITS", bits)
        for _ in range(400):
            a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            got = pages.aligned(a, b)
            rest = iter(b)
            assert all(i < j for i, j in pairwise(got)) and len(got) == table[-1][-1] and all(a[i] in rest for i in got)
