"""Operators that return what a plain loop over the texts gives."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import common, decontaminate, linededup, packing, records, simhash, spans
from tests.llm.data import LONG, TEXTS, documents, empty

GPT, CLIP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer(path, special_as_text=False):
    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return t


def plain_ids(path, text, special_as_text=False):
    return tokenizer(path, special_as_text).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("path", [GPT, CLIP])
def test_encoder_gives_the_ids_of_whole_texts(path, special_as_text):
    from sparkloom.llm.tokens import Encoder

    rng = random.Random(11)
    parts = list("aAbBzZ éÉßıİœŒ'.,!|<>09²  \n\n\t_-ΣςǅŉÈ日") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u0301", "\u3000", "\x1c", "'LL", "\r\n", " the"]
    fuzz = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    more = ["it's İ.x", "don't  'sfoo 's", "é́ éx áb", " lead", "trail ", "a　b c", "x_y z9 9z", "ＡＢ c", "a\x1cb c", "m² 3", "foó bar"]
    texts = [t or "" for t in TEXTS] + more + fuzz
    encoder = Encoder(path, special_as_text)
    for i in range(0, len(texts), 500):
        ids, edges = encoder.encode(texts[i : i + 500], 7)
        for k, text in enumerate(texts[i : i + 500]):
            assert ids[edges[k] : edges[k + 1]].tolist() == [*plain_ids(path, text, special_as_text), 7]
    assert [len(x) for x in encoder.encode([], 7)] == [0, 1]
    assert encoder.encode(["a", "", None or ""], 7)[0].tolist()[-2:] == [7, 7]


def test_encoder_ends_texts_by_each_calls_id(monkeypatch):
    from sparkloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)  # the cache starts anew between calls
    encoder = tokens.Encoder(CLIP)
    for end in (1, 9, 65_537):
        ids, edges = encoder.encode(["", "one two three four", ""], end)
        assert ids.tolist() == [end, *plain_ids(CLIP, "one two three four"), end, end] and edges.tolist() == [0, 1, len(ids) - 1, len(ids)]
        assert encoder.known[None] == 0  # the end is a word of the table, so that ids are gathered at once


# ------------------------------------------------------------------ decontamination


def item_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_decontaminate(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words,segment", [(1 << 20, 512), (50, 3)])
def test_decontaminate(spark, monkeypatch, block_words, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    items = [(1, TEXTS[5]), (2, "two words"), (10, "A b C d e f g h i j"), (3, None), (4, ""), (5, "!!"), (None, "word"), (7, " ".join(LONG.split()[500:530]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    docs = documents(spark)
    got = decontaminate.decontaminate(docs, bench, block_words=block_words)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute_decontaminate([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)
    kept = decontaminate.remove_contaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_one_block_is_searched_and_summed_by_one_worker_of_a_task(spark):
    bench = spark.createDataFrame([(1, TEXTS[5])], "item_id long, text string")
    found = decontaminate.remove_contaminated(documents(spark), bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(documents(spark), bench).filter("contaminated").count() == 0


def test_wu_manber_finds_all_occurrences():
    rng = np.random.default_rng(4)
    for length in (1, 2, 3, 5, 10):
        patterns = np.unique(rng.integers(0, 3, (30, length), dtype=np.int32), axis=0)
        sizes = np.array([0, 5, 700, 1, 1300, length, length - 1])
        text = rng.integers(-1, 3, int(sizes.sum())).astype(np.int32)
        text[700:700 + length] = patterns[-1]
        starts, found = decontaminate.WuManber(patterns, 4).find(text, sizes)
        want, begin = set(), 0
        for n in sizes.tolist():
            for i in range(begin, begin + n - length + 1):
                want |= {(i, k) for k, p in enumerate(patterns.tolist()) if text[i : i + length].tolist() == p}
            begin += n
        assert set(zip(starts.tolist(), found.tolist())) == want and len(starts) == len(want)


# ------------------------------------------------------------------ packing


def test_pack(spark):
    docs = documents(spark)
    rows = packing.pack(docs, GPT).collect()
    want = Counter()
    for r in docs.collect():
        ids = plain_ids(GPT, r.text) + [2]
        pieces, start, first = [], 0, len(ids) % 1024 or 1024
        while start < len(ids):
            end = start + (first if start == 0 else 1024)
            pieces.append((r.doc_id, len(pieces), start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start = end
        want.update(pieces)
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / 1024 + 2
    assert packing.pack(empty(spark), GPT).count() == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    b = packing.BestFit(10, open_bins=2)
    assert b.place(6) == (0, 0) and b.place(7) == (1, 0)  # free 4 and 3
    assert b.place(3) == (1, 7)  # the better fit, now full and closed
    assert b.place(8) == (2, 0) and b.place(5) == (3, 0)  # bin 2, with 2 free, is the fullest and closes
    assert b.place(2) == (0, 6)  # not in the closed one
    assert b.place(5) == (3, 5)


def test_packing_is_close_to_the_bound_and_the_bound_of_open_bins_acts():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.geometric(1 / 300, 60_000), 1024)
    b = packing.BestFit(1024)
    for n in lengths:
        b.place(int(n))
        assert b.open <= packing.OPEN_BINS
    assert b.closings > 1000
    assert b.made <= 1.02 * lengths.sum() / 1024


def test_packing_matches_plain_bounded_best_fit():
    rng = np.random.default_rng(6)
    fast, open_bins, made = packing.BestFit(100, open_bins=7), [], 0
    for n in rng.integers(1, 101, 3000).tolist():
        fitting = [b for b in open_bins if 100 - b[1] >= n]
        if fitting:
            best = max(b[1] for b in fitting)
            chosen = next(b for b in reversed(fitting) if b[1] == best)
            open_bins.remove(chosen)
        else:
            if len(open_bins) == 7:
                fullest = max(b[1] for b in open_bins)
                open_bins.remove(next(b for b in reversed(open_bins) if b[1] == fullest))
            chosen, made = [made, 0], made + 1
        assert fast.place(n) == (chosen[0], chosen[1])
        chosen[1] += n
        if chosen[1] < 100:
            open_bins.append(chosen)


# ------------------------------------------------------------------ records


def test_records_round_trip(spark):
    docs = documents(spark)
    path = common.shared_dir(spark, "t")
    records.write_records(docs, path, CLIP, shard_bytes=20_000)
    index = records.write_index(spark, path, common.shared_dir(spark, "i"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = plain_ids(CLIP, r.text) + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = index.select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert index.select("file").distinct().count() > 1
    some = records.read_by_index(spark, path, index.filter("doc_id in (3, 5, 15)")).collect()
    assert {r.doc_id: list(r.ids) for r in some} == {i: plain_ids(CLIP, TEXTS[i]) + [1] for i in (3, 5, 15)}
    assert {r.doc_id: list(r.ids) for r in records.read_records(spark, path).collect()}[4] == plain_ids(CLIP, "two words") + [1]


def test_records_empty(spark):
    path = common.shared_dir(spark, "t")
    records.write_records(empty(spark), path, CLIP)
    assert records.write_index(spark, path, common.shared_dir(spark, "i")).count() == 0


def test_frames_detect_damage():
    data = records.frame(b"one") + records.MARK + records.frame(b"two")
    assert [bytes(p) for _, p in records.frames(data)] == [b"one", b"two"]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.frames(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        list(records.frames(data[:-1]))
    wide = records.encode_record(1, 2, None, np.array([70_000, 1], "<u4"))
    assert records.decode_record(memoryview(wide))[2] is None and records.decode_record(memoryview(wide))[3].tolist() == [70_000, 1]


# ------------------------------------------------------------------ simhash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    values = sorted({f for _, f in fps})
    groups = brute_components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in fps:
        if d is not None:
            least[groups[f]] = min(d, least.get(groups[f], d))
    want = Counter((d, f"{f:016x}", least.get(groups[f])) for d, f in fps)
    assert Counter(map(tuple, rows)) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def brute_wide(text, size=5):
    """256 bits as four numbers: majorities of the shingles' hashes and of three mixes of each."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    out, full = [], 2**64 - 1
    for k in range(4):
        hashes = []
        for s in shingles:
            x = xxhash.xxh64_intdigest(s.encode(), seed=42)
            if k:
                x = (x + 0x9E3779B97F4A7C15 * k) & full
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
                x ^= x >> 31
            hashes.append(x)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return tuple(out)


def brute_keep(rows):
    """Numbers of the rows (doc_id, text) that stay: one of each group."""
    fps = [brute_wide(t) for _, t in rows]
    values = sorted(set(fps))
    apart = lambda a, b: [(x ^ y).bit_count() for x, y in zip(a, b)]
    near = lambda a, b: min(apart(a, b)) <= 8 and sum(apart(a, b)) <= 46
    groups = brute_components(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if near(a, b)])
    signed = lambda v: [common.signed(x) for x in v]
    best = {}
    for i, (d, _) in enumerate(rows):
        mine = (d is None, d or 0, signed(fps[i]))
        if mine < best.get(groups[fps[i]], ((True, 1 << 70),))[0]:
            best[groups[fps[i]]] = (mine, i)
    return sorted(i for _, i in best.values())


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("hot", [48, 1])
def test_keep_one(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows[i] for i in brute_keep(rows))
    assert simhash.keep_one(empty(spark)).count() == 0
    # rows that share an id: each goes or stays by its own text
    a, b = LONG[:3000], LONG[3000:6000]
    same = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (7, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(same).collect())) == sorted([(1, a), (5, b)])


def test_keep_one_finds_edited_copies_and_leaves_others(spark):
    from tests.llm.data import prose

    bases = [prose(1000 + i, 400) for i in range(60)]
    light, heavy = [edited(t, 0.01, i) for i, t in enumerate(bases)], [edited(t, 0.25, i) for i, t in enumerate(bases)]
    rows = list(enumerate(bases + light + heavy))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    likeness = lambda x, y: len(x & y) / len(x | y)
    like = [likeness(shingles(a), shingles(b)) for a, b in zip(bases, light)]
    near = [i for i, x in enumerate(like) if x >= 0.8]
    assert len(near) > 50 and sum(60 + i not in kept for i in near) >= 0.9 * len(near)
    assert set(range(60)) <= kept and set(range(120, 180)) <= kept  # similarity about 0.15


def test_keep_one_by_bands_of_similarity(spark):
    """Of copies at a similarity from 0.85 up nine in ten go, from 0.80 up most; of those at 0.5 and below nearly all stay.

    256 bits tell 0.80 from 0.75 roughly: at 0.80 they differ by 39, give or take six.
    """
    from tests.llm.data import prose

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    rows, bands = [], defaultdict(list)
    for i in range(360):
        base = prose(5000 + i, 80 + i % 7 * 90)
        copy = edited(base, (0.008, 0.015, 0.025, 0.032, 0.04, 0.15)[i % 6], i)
        a, b = shingles(base), shingles(copy)
        bands[min(0.95, int(len(a & b) / len(a | b) * 20) / 20)].append(2 * i + 1)
        rows += [(2 * i, base), (2 * i + 1, copy)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept >= set(range(0, 720, 2))
    for band, ids in bands.items():
        gone = sum(i not in kept for i in ids) / len(ids)
        if band >= 0.8 and len(ids) > 20:
            assert gone >= (0.9 if band >= 0.85 else 0.7), (band, gone, len(ids))
        if band <= 0.45:
            assert gone <= 0.1 or len(ids) < 10, (band, gone, len(ids))
    assert sum(b >= 0.8 and len(ids) > 20 for b, ids in bands.items()) == 4


@pytest.mark.parametrize("hot,block", [(48, 8192), (2, 8), (2, 8192)])
def test_links_connect_all_that_brute_force_connects(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).tolist() + [0, 2**64 - 1]
    values = set(base)
    for b in base[:20] + base[-2:]:  # chains and balls around some
        x = b
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    near = base[0]
    values |= {near ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    values = sorted(values)
    fps = spark.createDataFrame([(common.signed(v),) for v in values], "fp long")
    found = simhash.links_within(fps)
    links = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_components(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4])
    assert brute_components(values, links) == want
    if (hot, block) == (2, 8192):  # a forest in each bucket, of five partitions at most
        assert len(links) <= 5 * len(values)


def test_thresholds_hold_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (2000, 64)).astype(float)
    bits[:, 1] = bits[:, 0]  # correlated bits fall together
    plan = simhash.allocate(2000, bits.T @ bits, 4)
    assert sum(t for _, t in plan) >= 4 - len(plan) + 1
    groups = simhash.group_bits(2000, bits.T @ bits, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({0, 1} <= set(g) for g in groups)


def test_components_of_a_long_chain_and_a_star(spark):
    from sparkloom.llm.components import connected_components

    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)}
    assert got == want


# ------------------------------------------------------------------ lines


def brute_lines(docs):
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(strip(line)) >= 10:
                holders[strip(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[strip(x)]) < 2 or min(holders[strip(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_lines": 4, "probe_lines": 5}])
def test_dedup_lines(spark, options):
    docs = documents(spark)
    got = linededup.dedup_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(w[2] for w in want)
    assert linededup.keep_lines(docs).columns == docs.columns
    assert linededup.dedup_lines(empty(spark), **options).count() == 0


def test_lines_of_many_shards(spark, monkeypatch):
    lines = [f"line number {i} of some length" for i in range(300)]
    rng = random.Random(8)
    texts = ["\n".join([*rng.sample(lines, 20), f"own line of document {i}"]) for i in range(60)]
    docs = documents(spark, texts, extra=False)
    staged = []
    stage = common.stage
    monkeypatch.setattr(common, "stage", lambda df, label: staged.append((label, df.columns)) or stage(df, label))
    got = linededup.dedup_lines(docs, shard_lines=50, probe_lines=60).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == Counter(brute_lines(list(enumerate(texts))))
    # texts are written once, however many shards there are
    assert [label for label, columns in staged if any(c.startswith("c") and c[1:].isdigit() for c in columns)] == ["documents"]
    own = linededup.line_hashes(documents(spark, texts, extra=False).selectExpr("doc_id as row", "doc_id", "text"), 10)
    assert linededup.build_index(own, 50)[1] >= 5


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    first[:100] = first[100]  # keys that share a word
    second[200:300] = second[300]
    h = linededup.MinimalPerfectHash(first, second)
    again = linededup.MinimalPerfectHash.unpacked(h.packed())
    assert sorted(h(first, second).tolist()) == list(range(5000)) and (again(first, second) == h(first, second)).all()


# ------------------------------------------------------------------ spans


def brute_sentences(text):
    """Cut after . ! ? before white space, and after line ends, with the white space behind."""
    white, out, own, i = " \t\n\x0b\x0c\r", [], "", 0
    while i < len(text):
        own += text[i]
        i += 1
        if own[-1] == "\n" or own[-1] in ".!?" and (i == len(text) or text[i] in white):
            while i < len(text) and text[i] in white:
                own += text[i]
                i += 1
            out.append(own)
            own = ""
    return out + [own] * bool(own)


def brute_spans(docs, least=2, min_words=12):
    own = []
    for row, (d, t) in enumerate(docs):
        s = brute_sentences(t or "")
        low = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in s]
        runs = {}
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                if low[i] and sum(map(len, low[i:j])) >= min_words:
                    runs[i] = (j, tuple(w for x in low[i:j] for w in x))
                    break
        own.append((d, s, runs, row))
    seen, gone = set(), defaultdict(set)
    for d, s, runs, row in sorted(own, key=lambda o: (o[0] is None, o[0] or 0, o[3])):
        for i, (j, words) in sorted(runs.items()):
            if words in seen:
                gone[row] |= set(range(i, j))
            seen.add(words)
    return [(d, len(s), len(gone[row]), "".join(x for i, x in enumerate(s) if i not in gone[row])) for d, s, _, row in own]


def test_sentences_are_cut_as_said():
    more = ["a. b", "a.b. c", "x!? y\n\nz", "... !", "no end", "\n", " \n x", "end.", "a.\x1cb. c", "1.5 is. it"]
    for t in [t or "" for t in TEXTS] + more:
        assert [s.decode() for s in spans.sentences(t.encode())] == brute_sentences(t)


def test_dedup_spans(spark):
    docs = documents(spark)
    got = spans.dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", "text").collect()
    want = brute_spans([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, got)) == Counter(want) and any(w[2] for w in want)
    assert any(w[0] == 0 and w[1:] == (0, 0, "") for w in want)  # the null text
    assert spans.dedup_spans(empty(spark)).count() == 0


def test_a_shared_passage_goes_but_for_the_first(spark):
    passage = "One sentence of some words stands here. Another comes right after it now. A third one ends the whole of it."
    texts = [f"Own words {i} open this text in a way of their own. {passage} Then text {i} ends with its own {i} words." for i in range(5)]
    rows = {r.doc_id: r.text for r in spans.dedup_spans(documents(spark, texts, extra=False)).collect()}
    assert rows[0] == texts[0]
    for i in range(1, 5):
        assert passage not in rows[i] and f"words {i} open" in rows[i] and f"text {i} ends" in rows[i]
