"""Conversation tries, importance resampling and main text, against plain loops and labelled pages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import dom, extract, resample, trie
from tests.llm.data import LONG, TEXTS, documents, empty

# ------------------------------------------------------------------ conversations


def plain_trie(rows, group=5, most=9):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:2])] for c, v in conv.items()}
    if group:
        cut = {c: zlib.crc32(str(c).encode()) % most for c in conv}
        conv = {c: conv.get(c - c % group, [])[: cut[c]] + own[cut[c] :] for c, own in conv.items()}
    nodes = defaultdict(list)
    for c, own in conv.items():
        for d in range(len(own) + 1):
            nodes[tuple(own[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += children[k] == 0
        saved[k] += (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    out = []
    for k, own in nodes.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conv[c]) == len(k))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(own), len(k), up, len(own), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations(seed=5, n=160):
    r = random.Random(seed)
    first = [("system", "Be brief."), ("user", "Hello"), ("user", "Ärger 日本")]
    rows = []
    for c in range(n):
        if c % 11 == 5:  # no first of its group
            continue
        own = [first[0], first[1]] if c % 3 else [r.choice(first)]
        own = own + [(r.choice(["user", "assistant", None]), r.choice(["yes", "no", "", None, "why?"])) for _ in range(r.randint(0, 9))]
        if c in (7, 8, 9):
            own = own * 20  # long ones, equal for a while
        rows += [(c, i if i or c % 2 else None, role, text) for i, (role, text) in enumerate(own)]
    rows += [(c, i, "user", "the same to the end") for c in range(1000, 1400, 5) for i in range(3)]
    rows += [(None, 0, "user", "nobody's"), (2000, 0, None, None), (2001, 0, "user", LONG)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bounds", [{}, {"shard_rows": 30, "least_rows": 1, "chunk_ids": 3}, {"shard_rows": 2, "least_rows": 1}])
@pytest.mark.parametrize("group", [5, None])
def test_trie_equals_plain_loops(spark, bounds, group):
    rows = some_conversations()
    extra = [(*r, 1, 2, "k1") for r in rows]
    df = spark.createDataFrame(extra, f"{SCHEMA}, pos int, k1 int, owner string").repartition(3)
    got = trie.conversation_trie(df, group=group, **bounds).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows, group)


def test_trie_keeps_repeated_rows_as_turns_and_takes_empty_tables(spark):
    rows = [(3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, "user", "a")]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves) for r in got) == [(0, 2, 1), (1, 2, 1), (2, 1, 1)]
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA), group=5).collect() == []
    only_null = spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)
    assert trie.conversation_trie(only_null, group=5).collect() == []


def test_hot_paths_are_summed_in_blocks(spark, monkeypatch):
    from sparkloom.operators import ordered

    monkeypatch.setattr(ordered, "ONE_TASK_BYTES", 0)
    rows = some_conversations(6, 40)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), group=5, shard_rows=20, least_rows=1).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_louds_finds_paths():
    r = random.Random(3)
    paths = {tuple(r.choice([2, 5, -7]) for _ in range(d)) for d in range(1, 6) for _ in range(9)}
    paths = sorted({p[:i] for p in paths for i in range(1, len(p) + 1)}, key=len)
    number = {p: i + 1 for i, p in enumerate([*paths, ()])}
    number[()] = 0
    key = np.array([number[p] for p in paths])
    above = np.array([number[p[:-1]] for p in paths])
    level = np.array([len(p) for p in paths])
    # keys whose difference is the label
    mixed = {(): 0}
    for p in paths:
        mixed[p] = mixed[p[:-1]] ^ hash((len(p), p)) ^ 0
    k1, p1 = np.array([mixed[p] for p in paths]), np.array([mixed[p[:-1]] for p in paths])
    tree, rows, levels = trie.level_order(level, (k1, key), (p1, above))
    node = {(): 0} | {paths[row]: i + 1 for i, row in enumerate(rows)}
    assert tree.parents().tolist() == [node[paths[row][:-1]] for row in rows]
    for p in paths:
        assert tree.child(node[p[:-1]], mixed[p] ^ mixed[p[:-1]]) == node[p]
        assert len(tree.children(node[p])) == sum(q[:-1] == p for q in paths) == tree.degrees()[node[p]]
    assert tree.child(0, 12345) is None
    sizes = np.ones(len(paths) + 1, np.int64)
    trie.roll_up(tree, levels, sizes)
    assert all(sizes[node[p]] == sum(q[: len(p)] == p for q in paths) for p in paths)


# ------------------------------------------------------------------ importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_buckets(text, longest=3):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    s = Counter(b for _, t in docs for b in plain_buckets(t))
    t = Counter(b for x in target for b in plain_buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        own = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def test_resample_equals_plain_loops(spark):
    texts = [*TEXTS, *[" ".join(random.Random(i).choices(["the", "of", "Zebra", "9", "naïve", "ß"], k=10 + i)) for i in range(90)]]
    docs, target = documents(spark, texts), spark.createDataFrame([("The zebra of the",), (None,), ("",)], "text string")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_resample(plain, [r.text for r in target.collect()])
    got = sorted((tuple(r) for r in resample.resample(docs, target).drop("n_words").collect()), key=repr)
    assert got == want and sum(r[4] is not None for r in got) >= 4
    # an empty target, and no documents
    none = spark.createDataFrame([], "text string")
    got = sorted((tuple(r) for r in resample.resample(docs, none).drop("n_words").collect()), key=repr)
    assert got == plain_resample(plain, [])
    assert resample.resample(empty(spark), target).collect() == []


def test_equal_scores_go_to_the_smaller_ids(spark):
    rows = spark.range(5000).selectExpr("cast(id as bigint) as doc_id", "30L as n_words", "0L as n_features", "0L as weight", "cast(id % 2 as bigint) as score")
    got = resample._ranked(rows, 2600).filter("rank is not null").orderBy("rank").collect()
    assert [r.doc_id for r in got] == [*range(1, 5000, 2), *range(0, 200, 2)]
    assert [r["rank"] for r in got] == list(range(1, 2601))


@pytest.mark.parametrize("step", [5, 61, 1 << 20])
def test_checksums_of_word_runs(step):
    texts = [t for t in TEXTS if step > 5 or len(t or "") < 3000]
    texts += ["Ab" * 70 + " c d " + "é" * 60 + " Z9", "q" * 100_000 + " b", "a", "b c", "日本 x", "", None, "z" * 48 + " " + "z" * 49]
    found, words = defaultdict(list), Counter()
    for own, sums, w in resample.features(*resample._buffers(pa.array(texts)), 3, step):
        words.update(w.tolist())
        for i, c in zip(own.tolist(), sums.tolist()):
            found[i].append(c % 10000)
    for i, t in enumerate(texts):
        assert sorted(found[i]) == sorted(plain_buckets(t)) and words[i] == len(plain_words(t))
    sliced = pa.array(texts).slice(3, 2)
    assert sum(len(s) for _, s, _ in resample.features(*resample._buffers(sliced))) == sum(len(plain_buckets(t)) for t in texts[3:5])


# ------------------------------------------------------------------ main text


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(extract.labelled_nodes(spark))


def test_trees_give_the_models_odds(spark, model):
    rows = extract.labelled_nodes(spark, 5, seed=10**6).select("features")
    x = np.array([r.features.toArray() for r in rows.collect()], np.float32)
    want = np.array([r.probability[1] for r in model.transform(rows).select("probability").collect()])
    assert np.allclose(1 / (1 + np.exp(-extract.Trees(model).log_odds(x))), want)


def test_decoding_on_pages_not_seen(model):
    trees, blocks = extract.Trees(model), dom.Blocks()
    for i in range(300):
        blocks.read(extract.Page(10**6 + i).html())
    a = blocks.arrays()
    odds = trees.log_odds(dom.features(a))
    keep, (y, some) = dom.decode(a, odds), dom.labels(a)
    inner, parent = a["parent"] >= 0, a["parent"]
    assert not (keep[inner] & ~keep[parent[inner]]).any() and not (keep & ~some).any()
    for i in np.flatnonzero(keep & (a["group"] != dom.TEXT)):
        assert keep[parent == i].any()
    run = a["group"] == dom.TEXT
    right = lambda k: ((k == (y == 1)) & run & some).sum() / (run & some).sum()
    chars = a["chars"] * run
    assert right(keep) > 0.96 and right(keep) > right(odds > 0)
    assert (chars * (keep & (y == 1))).sum() > 0.97 * (chars * keep).sum()
    assert (chars * (keep & (y == 1))).sum() > 0.97 * (chars * (y == 1)).sum()


def test_decoding_is_the_best_consistent_choice():
    """Against all choices, on small trees."""
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 10))
        parent = np.array([-1, *[int(r.integers(0, i)) for i in range(1, n)]])
        leaf = ~np.isin(np.arange(n), parent)
        leaf[0] = False
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        group = np.where(leaf, dom.TEXT, dom.GROUP["box"])
        a = {"parent": parent, "depth": depth, "group": group, "chars": leaf * 5, "label": leaf * 0}
        odds = r.normal(size=n) * 2
        best, choice = 0.0, np.zeros(n, bool)
        for bits in range(1 << n):
            k = np.array([bits >> i & 1 for i in range(n)], bool)
            fits = all(not k[i] or (i == 0 or k[parent[i]]) and (leaf[i] or k[parent == i].any()) for i in range(n))
            if fits and odds[k].sum() > best:
                best, choice = odds[k].sum(), k
        assert (dom.decode(a, odds) == choice).all()


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="<p>nor this</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a><li><a href=/c>Three</a></ul></nav><!-- <p>nor this --><div class="ad">Buy this now. It is cheap.</div>
<article><h1>A &quot;title&quot; &amp
here</h1><p>First  paragraph,\nwith <b>bold<br>words &lt;3 and a few more of them. It goes on for a while.<p>Second 日本 paragraph &#233;. There is more to say here.
<ul><li>an item of some length.<li>another item of some length.</ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><a href="#">Ann</a> 3 h<p>I liked this one.</p></div><div class="comment"><a href="#">Bob</a> 4 h<p>So did I.</p></div></section>
<footer>&copy; example.com &middot; All rights.</footer>"""
TEXT = (
    'A "title" & here\n\nFirst paragraph, with bold words <3 and a few more of them. It goes on for a while.\n\n'
    "Second 日本 paragraph é. There is more to say here.\n\nan item of some length.\n\nanother item of some length."
)


def test_extract_keeps_the_article(spark, model):
    rows = [(1, "u", PAGE, 3), (2, None, None, 3), (3, "v", "", 3), (None, "w", PAGE, 3), (1, "u", PAGE, 3)]
    rows += [(9, "x", PAGE.replace("Second", "long " * 40_000 + "Second"), 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = {(r.page_id, r.url): r for r in extract.extract(df, model=model).collect()}
    assert len(got) == 5 and got[1, "u"].text == got[None, "w"].text == TEXT and got[1, "u"].n_chars == len(TEXT)
    assert got[2, None].text == got[3, "v"].text == "" and got[3, "v"].n_chars == 0
    assert got[9, "x"].text == TEXT.replace("Second", "long " * 40_000 + "Second")
    assert extract.extract(df, model=model).count() == 6
    assert extract.extract(df.limit(0), model=model).collect() == []


def test_markup_of_every_kind_is_read():
    odd = ["<", "<>", "a < b", "<p", "<p class='x", "</p></div>", "<!--", "<![CDATA[x]]>", "<p>&am", "<script>x", "<b><i><p>x</b></i>", "<table><tr><td>a<td>b<tr><td>c</table>"]
    odd += ["<div>" * 3000 + "deep", "<select><option>no</select>yes", "<button>", "\0", "<p>a<div>b</p>c</div>d"]
    blocks = dom.Blocks()
    for html in odd:
        blocks.read(html)
    a = blocks.arrays()
    texts = [[t for t, p in zip(blocks.texts, a["page"]) if p == i and t] for i in range(len(odd))]
    assert texts[:3] == [["<"], ["<>"], ["a < b"]] and texts[8] == ["&am"] and texts[9] == [] and texts[10] == ["x"]
    assert texts[11] == ["a", "b", "c"] and texts[12] == ["deep"] and texts[13] == ["yes"] and texts[16] == ["a", "b", "c", "d"]
    assert np.isfinite(dom.features(a)).all()
    assert dom.decode(a, np.full(len(a["page"]), -1.0)).sum() == 0
