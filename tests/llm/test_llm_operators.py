"""The ten operators on small fixtures, held against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with inner ones."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftwork.llm import decontamination, fingerprints, langid, licenses, mixing, quality, sharding, simhash, tokencounts, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, node long, score double, row int"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()


def _words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def _rows(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = _words(r, r.randrange(5, 80))
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])))
    out.append((n, None, None, None))
    out.append((n + 1, "", "en", "a"))
    out.append((n + 2, " \t\n", "en", "a"))
    out.append((n + 3, _words(r, 20_000), "en", "b"))
    out.append((None, "no id here at all", "en", "b"))
    out.append((n + 4, out[3][1], "en", "c"))
    out += [out[5]] * 3
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 0.5, 3) for r in _rows()], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 != 0, i % 4 == 0) for i in range(60)] + [(None, True, True), (5, None, None)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")


# 2 Mixing


def _targets(sizes, share=1.5, weights=(5, 2, 1), most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes, rows = {}, docs.select("source", "text", "doc_id").collect()
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = _targets(sizes)
    taken, source = {}, {r.doc_id: r.source for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    longest = max(r.size for r in got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def test_mixed_rows_follow_the_mix(docs):
    want = {}
    for r in mixing.copies(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v} and mixing.mixed(docs).columns == docs.columns


def test_mixed_takes_wordless_rows_like_the_mix(spark):
    d = spark.createDataFrame([(i, ("a b c", "", None)[i % 3], None, "ab"[i % 2]) for i in range(300)], "doc_id long, text string, lang string, source string")
    want = {r.doc_id: r.copies for r in mixing.copies(d).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixing.mixed(d).groupBy("doc_id").count().collect()} == want


def test_mixing_near_targets_with_many_small_documents(spark):
    r = random.Random(3)
    d = spark.createDataFrame([(i, _words(r, r.randrange(1, 9)), None, r.choice("aaaaab")) for i in range(4000)], "doc_id long, text string, lang string, source string")
    by = mixing.mix_sources(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(x.t - x.goal) <= 9 for x in by)


# 3 Fingerprints


@lru_cache(maxsize=None)
def _hash(run):
    """The polynomial of the mixed code points, mixed again."""
    y = fingerprints.mix(np.frombuffer(run.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)).tolist()
    n = sum(v * pow(0x9E3779B97F4A7C15, len(y) - 1 - i, 1 << 64) for i, v in enumerate(y)) % (1 << 64)
    return int(fingerprints.mix(np.array([n], dtype=np.uint64))[0])


@lru_cache(maxsize=None)
def _anchors(text):
    """Closed syncmers by their definition, run by run."""
    K, S, h = fingerprints.K, fingerprints.S, _hash
    if len(text) < K:
        return [(0, hashlib.sha256(text.encode("utf-32-le")).digest()[:4][::-1].hex())] if text else []
    out = []
    for i in range(len(text) - K + 1):
        inner = [h(text[i + j : i + j + S]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, f"{h(text[i : i + K]) >> 32:08x}"))
    return out


def _written(anchors):
    return "".join(f"{h}{at - before:02x}" for (at, h), before in zip(anchors, [0, *(a for a, _ in anchors)]))


def _like(a, b):
    """Longest common subsequence over anchors told apart by their count among equals (so each pairs with one at most)."""

    def nth(anchors):
        seen, out = {}, []
        for _, h in anchors:
            seen[h] = seen.get(h, 0) + 1
            out.append((h, seen[h]))
        return out

    x, y = nth(a), nth(b)
    if not x or not y:
        return float(len(x) == len(y))
    row = [0] * (len(y) + 1)
    for p in x:
        row = [0, *row[1:]]
        new = [0]
        for j, q in enumerate(y, 1):
            new.append(row[j - 1] + 1 if p == q else max(row[j], new[-1]))
        row = new
    return 2 * row[-1] / (len(x) + len(y))


def _fingerprint_rows():
    r = random.Random(12)
    rows = [(i, _words(r, r.randrange(3, 40))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "é" * 70), (103, "short"), (7, _words(r, 20)), (7, "again the seventh"), (None, _words(r, 9)), (None, "b"), (None, None)]
    return rows + [rows[3]] * 2


def _expected_prints(rows):
    rows = [(i, t or "") for i, t in rows]
    rows = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), _tie(x[1])))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = _anchors(t), _anchors(edited), _anchors(after)
        out.append(str((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _written(a), _written(b), round(_like(a, b), 9), round(_like(a, c), 9))))
    return sorted(out)


def _tie(text):
    n = xxhash.xxh64_intdigest(text.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("run", [1 << 20, 600])
def test_fingerprints_by_brute_force(spark, monkeypatch, run):
    rows = _fingerprint_rows()
    d = spark.createDataFrame([(*x, 1, True) for x in rows], "doc_id long, text string, run long, ghost boolean").repartition(3)
    got = sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in fingerprints.fingerprint(d, run).collect())
    assert got == _expected_prints(rows)


def test_many_equal_rows_are_sent_as_one(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "EQUAL", 5)
    rows = _fingerprint_rows() + [(None, "the same text of no id, many times over")] * 30 + [(5, "five")] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in fingerprints.fingerprint(d).collect())
    assert got == _expected_prints(rows)


def test_fingerprints_read_back_and_know_order():
    r = random.Random(3)
    a, b = _words(r, 150), _words(r, 150)
    one, two, swapped = (fingerprints.Document(x) for x in (f"{a} {b}", f"{a} {_words(r, 3)} {b}", f"{b} {a}"))
    at, hashes = fingerprints.read(fingerprints.written_out(one.at, one.hashes))
    assert at.tolist() == one.at.tolist() and hashes.tolist() == one.hashes.tolist()
    assert fingerprints.likeness(one.hashes, two.hashes) > 0.9 and 0.4 < fingerprints.likeness(one.hashes, swapped.hashes) < 0.6
    long = _words(r, 40_000)
    d = fingerprints.Document(long)
    assert np.diff(d.at).max() < fingerprints.K and len(d.points) > 200_000


# 5 SimHash


def _simhash(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    r = random.Random(5)
    rows = [(i, t) for i, t, _, _ in _rows(40) if i is None or i != 43]
    base = _words(r, 400).split()
    for i in range(100, 130):
        w = list(base)
        w[r.randrange(400)] = "changed"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_components(d).collect()
    assert len(got) == len(rows)
    prints = [_simhash(t) for _, t in rows]
    roots = _components(prints)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(root))) for (i, _), p, root in zip(rows, prints, roots))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want


def test_bit_sliced_comparison_by_brute_force():
    rng = np.random.default_rng(2)
    for lanes, radius in ((1, 4), (8, 92)):
        base = rng.integers(0, 1 << 63, size=(700, lanes), dtype=np.uint64)
        for i in range(0, 300):
            for _ in range(rng.integers(0, 8 * lanes)):
                base[i + 300] = base[i] if _ == 0 else base[i + 300]
                base[i + 300, rng.integers(lanes)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        want = {(i, j) for i in range(700) for j in range(i + 1, 700) if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(base[i], base[j])) <= radius}
        got = {(int(a), int(b)) for i, j in simhash.near(base, radius) for a, b in zip(i, j)}
        assert got == want and want


def test_chunked_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    r = random.Random(8)
    start = r.getrandbits(64)
    nodes = sorted({start ^ sum(1 << b for b in r.sample(range(13, 64), r.randrange(6))) for _ in range(120)})
    signed = [n - (1 << 64) if n >> 63 else n for n in nodes]
    cells = spark.createDataFrame([(7, n, [n]) for n in signed], "cell long, node long, print array<long>")
    roots = {x.node: x.root for x in simhash.components(simhash.links(cells, 4)).collect()}
    got = [roots.get(n, n) for n in signed]
    want = _components(nodes)
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


@pytest.mark.parametrize("cell", [8, 24])
def test_divided_cells_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(cell)
    nodes = {r.getrandbits(64) & ~0x1FFF for _ in range(150)}
    nodes |= {n ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for n in list(nodes)[:80]}
    nodes = sorted(nodes)
    signed = [n - (1 << 64) if n >> 63 else n for n in nodes]
    cells = spark.createDataFrame([(7, n, [n]) for n in signed], "cell long, node long, print array<long>")
    roots = {x.node: x.root for x in simhash.components(simhash.links(cells, 4)).collect()}
    got, want = [roots.get(n, n) for n in signed], _components(nodes)
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_deduplicated(spark):
    r = random.Random(4)
    rows = []
    for g in range(12):
        base = _words(r, 200).split()
        rows.append((100 * g, " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            for _ in range(2):
                w[r.randrange(200)] = f"x{r.random()}"
            rows.append((100 * g + k, " ".join(w)))
    rows += [rows[0], rows[0], (9999, rows[0][1]), (None, rows[4][1]), (None, "alone without an id"), (5000, "a text of its own, short")]
    d = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, h long, row string")
    got = simhash.deduplicated(d)
    assert got.columns == d.columns
    assert sorted(str(x.doc_id) for x in got.collect()) == sorted([*(str(100 * g) for g in range(12)), "None", "5000"])


# 4 Decontamination


def test_deduplicated_links_by_exact_similarity(spark):
    r = random.Random(9)
    texts = []
    for _ in range(40):  # similarity from about 0.6 up, across the limit
        base = _words(r, 120).split()
        w = list(base)
        for at in r.sample(range(5, 115), r.randrange(1, 6)):
            w[at] = f"x{r.random()}"
        texts += [" ".join(base), " ".join(w)]
    for _ in range(10):  # equal sets of shingles, a tenth of them twice in one text and seven times in the other
        words, loop = _words(r, 90).split(), _words(r, 10).split()
        texts += [" ".join(words + loop * 3), " ".join(words + loop * 8)]
    for _ in range(20):  # 4 shingles of 5: similarity 0.8
        w = _words(r, 9).split()
        texts += [" ".join(w[:8]), " ".join(w)]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.deduplicated(d).collect()) == sorted(set(root))
    assert 20 < len(texts) - len(set(root)) < len(texts) / 2


def test_similar_sets_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 300)
    r = random.Random(10)
    base, rows = _words(r, 100).split(), []
    for i in range(24):
        w = list(base)
        w[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x.doc_id for x in simhash.deduplicated(d).collect()] == [0]


def test_decontamination(spark):
    r = random.Random(6)
    items = [(i, _words(r, r.randrange(12, 60))) for i in range(30)] + [(98, "too short"), (97, "Rather!"), (99, None), (None, _words(r, 20)), (96, "...")]
    rows, want = [], {}
    for i in range(120):
        text = _words(r, 150).split()
        k = r.randrange(30)
        w = items[k][1].upper().split()
        most = int(0.2 * len(w))
        edits = r.randrange(0, most + 1) if i % 3 else most + 6
        for p in r.sample(range(len(w)), min(edits, len(w))):
            w[p] = f"Edited{r.random()}".replace(".", "")
        rows.append((i, " ".join(text[:70] + w + text[70:]) if i % 4 else " ".join(text)))
        if i % 4 and i % 3:
            want[i, k] = edits
    rows += [(1000, None), (1001, ""), (1002, items[3][1]), (1002, items[3][1]), (1003, "that is Too, short. and rather long"), (1004, "too very short")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(d, b).collect()
    got = {(x.doc_id, x.item_id): x.edits for x in found}
    assert len([1 for x in found if x.doc_id == 1002]) == 2
    assert set(got) - set(want) == {(1002, 3), (1003, 98), (1003, 97)} and all(got[k] <= want[k] for k in got if k in want)
    assert len(set(want) & set(got)) >= 0.9 * len(want)
    assert {x.doc_id for x in decontamination.clean(d, b).collect()} == {i for i, _ in rows} - {k for k, _ in got}
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.clean(d, b.limit(0)).count() == len(rows)


def test_least_edits_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, t = rng.integers(0, 4, 8).astype(np.uint64), rng.integers(0, 4, 20).astype(np.uint64)

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                new = [i]
                for j, q in enumerate(y, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
                row = new
            return row[-1]

        assert decontamination.least_edits(a, t)[0] == min(distance(a, t[i:j]) for i in range(21) for j in range(i, 21))


def _edited(r, words, kind, edits):
    w = list(words)
    for _ in range(edits):
        k = r.choice("sdi") if kind == "any" else kind
        at = r.randrange(len(w))
        w[at : at + (k != "i")] = [] if k == "d" else [f"e{r.getrandbits(40)}"]
    return w


@pytest.mark.parametrize("kind", ["s", "d", "i", "any"])
def test_recall_at_the_limit(kind):
    """Whole search against all windows: items at a fifth of edits, in texts of 300 words."""
    r = random.Random(kind)
    for size in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40, 60):
        items, texts = [], []
        for i in range(100):
            w = [f"w{r.getrandbits(40)}" for _ in range(size)]
            items.append(w)
            filler = [f"f{r.getrandbits(40)}" for _ in range(300)]
            texts.append(" ".join(filler[:150] + _edited(r, w, kind, int(0.2 * size + 1e-9)) + filler[150:]))
        symbols, first = decontamination.tokens(pa.array([" ".join(w) for w in items]))
        known = decontamination.Items([[i] for i in range(100)], [symbols[a:b] for a, b in zip(first[:-1], first[1:])])
        found = known.search(*decontamination.tokens(pa.array(texts)))
        assert sum(any(m[0] == i for m in ms) for i, ms in enumerate(found)) >= (95 if size >= decontamination.LEAST else 100), size
        assert sum(len(ms) for ms in found) <= 100


def test_search_finds_what_all_windows_find():
    """Least edits by Sellers over every text and item, few distinct words, so that many windows are near."""
    r = random.Random(2)
    items = [[r.choice("abcdefghij") * 2 for _ in range(r.randrange(1, 25))] for _ in range(40)] + [["la"] * 12]
    texts = [[r.choice("abcdefghij") * 2 for _ in range(r.randrange(0, 80))] + r.choice(items) for _ in range(60)] + [["la"] * 40, []]
    symbols, first = decontamination.tokens(pa.array([" ".join(w) for w in items]))
    distinct = {tuple(w): i for i, w in enumerate(items)}
    known = decontamination.Items([[i] for i in distinct.values()], [symbols[first[i] : first[i + 1]] for i in distinct.values()])
    found = known.search(*decontamination.tokens(pa.array([" ".join(t) for t in texts])))
    hit = whole = 0
    for t, ms in zip(texts, found):
        got = {m[0]: m[2] for m in ms}
        for w, i in distinct.items():
            row = [0] * (len(t) + 1)
            for n, p in enumerate(w, 1):
                new = [n]
                for j, q in enumerate(t, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
                row = new
            most = int(0.2 * len(w) + 1e-9)
            if min(row) <= most:
                assert len(w) >= decontamination.LEAST or got[i] == min(row)
                whole, hit = whole + 1, hit + (got.get(i) == min(row))
            else:
                assert i not in got
    assert whole > 200 and hit >= 0.95 * whole


def test_common_phrases_take_bounded_time():
    r = random.Random(1)
    phrase = [f"p{i}" for i in range(17)]
    items = [" ".join(phrase + [f"w{r.getrandbits(40)}" for _ in range(30)]) for _ in range(2000)]
    symbols, first = decontamination.tokens(pa.array(items))
    known = decontamination.Items([[i] for i in range(2000)], [symbols[a:b] for a, b in zip(first[:-1], first[1:])])
    text = decontamination.tokens(pa.array([" ".join((phrase + ["z"] * 20) * 20), items[7]]))
    known.search(*text)
    began = time.time()
    found = known.search(*text)
    assert time.time() - began < 2 and [m[0] for m in found[1]] == [7] and not found[0]


def test_unspaced_scripts_and_very_long_texts(spark):
    r = random.Random(8)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40))
    d = spark.createDataFrame([(1, "前言，" + han[:20] + "。" + han[20:] + "后记"), (2, "别的"), (3, _words(r, 30_000) + " " + "ten small words that stand in a very long text " + _words(r, 30_000))], "doc_id long, text string")
    b = spark.createDataFrame([(5, han), (6, "Ten small words, that stand in a very long text")], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id, x.edits) for x in decontamination.contaminated(d, b).collect()) == [(1, 5, 0), (3, 6, 0)]


# 1, 6, 8 Learned operators


def _spread(spark, bad, n=900, flip=0.0):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = _words(r, r.randrange(10, 60)).split()
        y = i % 3 == 0
        if y:
            w = bad(w, r)
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_toxicity_held_out(spark):
    def insult(w, r):
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["nasty", "vile", "grubby"]))
        return w

    d, y = _spread(spark, insult)
    labels = spark.createDataFrame(y, "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, labels).collect()
    assert len(got) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, dict(y)[r.doc_id]) for r in got if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(r.evidence for r in got if r.predicted)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    n, size = 6 * toxicity.BLOCK - 40, 300
    w = np.where(rng.random((size, n)) < np.r_[np.full(20, 0.3), np.full(size - 20, 0.02)][:, None], rng.random((size, n)), 0)
    term, example = np.nonzero(w)
    index = toxicity.Index.of(np.arange(size, dtype=np.uint64), np.ones(size), 1.0, np.arange(n), rng.integers(0, 2, n).astype(float), example, term, w[term, example])
    index.ready()
    assert (index.row >= 0).any() and (index.row < 0).any()
    for k in range(60):
        which = np.sort(rng.choice(size, 12, replace=False))
        q = rng.random(12)
        without = int(rng.integers(n)) if k % 2 else -1
        best, cosines = index.nearest(which, q, without)
        whole = q @ w[which]
        if without >= 0:
            whole[without] = 0
        order = np.lexsort((np.arange(n), -np.round(whole, 6)))[: toxicity.K]
        order = order[whole[order] > 1e-6]
        assert np.allclose(cosines, whole[order], atol=2e-6) and np.allclose(np.sort(whole[best]), np.sort(whole[order]), atol=2e-6)


def test_toxicity_vectors_by_definition(spark):
    """Index weights, cosines and evidence, worked out with dicts."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 30))) + (" vile wretch" if i % 5 == 0 else "") + (f" Only{chr(97 + i % 26)}" if i % 2 else "")) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "12 34 !!"), (93, rows[4][1]), (4, rows[4][1])]
    labels = [(i, int(i % 5 == 0)) for i in range(92)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.build(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    bag = lambda t: Counter(w.lower() for w in re.findall("[A-Za-z]+", t or ""))
    held = Counter(w for _, t in rows for w in bag(t))
    known = {i: bag(t) for i, t in rows if i < 92 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(known) == sorted(index.ids.tolist())
    idf = {w: math.log((len(rows) + 1) / (held[w] + 1)) + 1 for w in held}
    vocabulary = {w for b in known.values() for w in b}
    keys = {w: int(toxicity.terms(pa.array([w]))[1][0]) for w in vocabulary}
    weight = {w: index.weight[np.searchsorted(index.keys, keys[w])] for w in vocabulary}
    for w in vocabulary:
        assert idf[w] * toxicity.TELL - 1e-9 <= weight[w] <= idf[w] + 1e-9
    assert min(weight["vile"] / idf["vile"], weight["wretch"] / idf["wretch"]) > 0.5 > weight["oak"] / idf["oak"]
    rare = (math.log((len(rows) + 1) / 2) + 1) * toxicity.TELL

    def unit(b):
        v = {w: (1 + math.log(k)) * weight.get(w, rare) for w, k in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: unit(b) for i, b in known.items()}
    for t in (rows[1][1], rows[5][1] + " unknown words", "oak vile", rows[40][1]):
        (_, which, w), = index.vectors(*toxicity.terms(pa.array([t])))
        best, cosines = index.nearest(which, w)
        q = unit(bag(t))
        want = sorted((sum(x * v.get(k, 0) for k, x in q.items()) for v in vectors.values()), reverse=True)[: toxicity.K]
        assert np.allclose(cosines, want[: len(cosines)], atol=2e-6) and len(cosines) == sum(x > 1e-6 for x in want)


def test_long_examples_are_bounded_by_their_terms(spark):
    rows = spark.createDataFrame([(i, [1] * 10) for i in range(50)], "doc_id long, terms array<int>")
    assert toxicity.within(rows, 500).count() == 50
    some = sorted(x.doc_id for x in toxicity.within(rows, 123).collect())
    assert len(some) == 12 and some == sorted(x.doc_id for x in toxicity.within(rows.repartition(7), 123).collect())


def test_votes_weigh_examples_by_their_distance():
    """Votes from the definition: cosines of the nearest examples weigh their labels; nothing near gives the prior; ties by cosine."""
    r = np.random.default_rng(4)
    n, many = 60, 40
    size = r.integers(1, 12, n)
    example, term = np.repeat(np.arange(n), size), np.concatenate([r.choice(many, k, replace=False) for k in size])
    value = r.random(len(term)) + 0.1
    value /= np.sqrt(np.bincount(example, value**2))[example]
    y = r.integers(0, 2, n).astype(float)
    index = toxicity.Index.of(np.arange(many, dtype=np.uint64), np.ones(many), 1.0, np.arange(n), y, example, term, value)
    dense = np.zeros((n, many))
    dense[example, term] = value
    for q in range(30):
        which = np.sort(r.choice(many, 6, replace=False))
        weights = r.random(6)
        weights /= np.sqrt((weights**2).sum())
        cosines = dense[:, which] @ weights
        best, got = index.nearest(which, weights)
        want = np.sort(cosines[cosines > 0])[::-1][: toxicity.K]
        assert np.allclose(np.sort(got)[::-1], want, atol=1e-6) and np.allclose(cosines[best], got, atol=1e-6)
        vote = index.vote(best, got)
        pull = 0.5 * got.max()
        assert vote == pytest.approx((sum(c * y[b] for c, b in zip(got, best)) + pull * index.prior) / (got.sum() + pull))
        if len(set(y[best])) == 1 and len(best) == toxicity.K:
            assert (vote > 0.5) == bool(y[best[0]])
    assert index.vote(np.zeros(0, np.int64), np.zeros(0)) == index.prior


def test_log_likelihood_ratio_by_definition():
    held, n = np.array([[3.0, 0, 10, 2], [9, 5, 20, 0]]), np.array([30.0, 60.0])
    for j, got in enumerate(toxicity.ratio(held, n)):
        table = np.array([held[:, j], n - held[:, j]])
        expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
        assert got == pytest.approx(2 * sum(o * math.log(o / e) for o, e in zip(table.ravel(), expected.ravel()) if o))


def test_quality_held_out(spark):
    d, y = _spread(spark, lambda w, r: [x + "###" for x in w])
    labels = spark.createDataFrame([(i, 1 - q) for i, q in y], "doc_id long, quality int")
    got = quality.classify(d, labels).collect()
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, 1 - dict(y)[r.doc_id]) for r in got if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {r.doc_id for r in quality.accepted(d, labels).collect()} == {r.doc_id for r in got if r.predicted}


def _statistics(text):
    """The statistics one by one, from their definition."""
    b = (text or "").encode()
    stops = b".,;:!?'\"()-"
    kind = lambda c: 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c in b" \t\v\f\r" else 4 if c == 10 else 5 if c in stops else 7 if c >= 0xC0 else 8 if c >= 0x80 else 6
    counts = [sum(kind(c) == k for c in b) for k in range(9)]
    chars, w = max(len(text or ""), 1), re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, some, low = len(w), max(len(w), 1), [x.lower() for x in w]
    share = [
        sum(x == y for x, y in zip(low, low[1:])),
        sum(kind(x[0]) == 0 for x in w),
        sum(len(x) > 1 and all(kind(c) == 0 for c in x) for x in w),
        sum(kind(x[-1]) == 5 for x in w),
        sum(kind(x[-1]) == 6 for x in w),
        sum(len(x) == 1 and kind(x[0]) == 6 for x in w),
        sum(len(x) > 20 for x in w),
    ]
    one, two = Counter(low), Counter(zip(low, low[1:]))
    tail = [len(one) / n, max(one.values()) / n] if n else [0, 0]
    tail += [len(two) / (n - 1), max(two.values()) / (n - 1)] if n > 1 else [0, 0]
    return [math.log1p(chars), *(c / chars for c in counts[:8]), math.log1p(n), chars / some, *(x / some for x in share), *tail]


def test_statistics_by_definition():
    r = random.Random(12)
    parts = ["Alder", "BIRCH", "c", "é", "naïve", "漢字", "#", "%%%", "x.", "y,", "(z)", "1234", "a" * 25, "\x00", "end#", "the", "the", "The", "\n", "\t", "  ", "-"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(80)] + [None, "", " \n\t", "one", "one one", "ONE", "漢"]
    texts += ["ends with same", "same begins here", "same"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape[1] == 22
    assert np.allclose(got, [_statistics(t) for t in texts], rtol=1e-5, atol=1e-6)
    order = r.sample(range(len(texts)), len(texts))
    assert (quality.statistics(pa.array([texts[i] for i in order], pa.string())) == got[order]).all()
    assert quality.statistics(pa.array([], pa.string())).shape == (0, 22)


def test_trees_as_arrays_descend_like_trees():
    rng = np.random.default_rng(4)
    x = rng.random((500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit(x, y)
    slow = []
    for row in x[:100]:
        m = t.base
        for f, h, v in zip(t.feature, t.threshold, t.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > h[node])
            m += v[node - len(f)]
        slow.append(m)
    assert np.allclose(t.margin(x[:100]), slow) and ((t.score(x) > 0.5) == y).mean() > 0.95


def test_language_held_out(spark):
    r = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ver", "ung", "ein"], "cc": ["ção", "nho", "ar", "es"]}
    rows = [(i, " ".join("".join(r.choices(parts[lang], k=3)) for _ in range(r.randrange(4, 60))), lang) for i, lang in enumerate(r.choices(list(parts), k=400))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (None, "schverung", None), (1003, "verung " * 30_000, "bb")]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "bb", "bb"]
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:400] if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98 and all(0 <= x.score <= 1 for x in got.values())


def _phrases(text, query, piece):
    """Phrases of a query by looking each one up in the text, cut every `piece` characters."""
    clean, n = "", 0
    for c in query:
        c = c if c.isalpha() else " "
        if c != " " or not clean.endswith(" "):
            clean += c
    for a in range(0, len(clean), piece):
        part, at = clean[a : a + piece], 0
        while at < len(part):
            k = 0
            while at + k < len(part) and part[at : at + k + 1] in text:
                k += 1
            n, at = n + 1, at + max(k, 1)
    return n


def _parser(text):
    alphabet = "".join(sorted({c for c in text if c.isalpha()}))
    ids = {c: langid.ALIEN + 1 + i for i, c in enumerate(alphabet)}
    symbols = [ids.get(c, langid.GAP) for c in text]
    edges = np.array([(s, c, n) for s, row in enumerate(langid.automaton(symbols)) for c, n in row.items()], dtype=np.int32)
    return langid.Parsers(["x"], alphabet, [edges])


def test_phrases_by_brute_force():
    text = "abracadabra abra"
    p = _parser(text)
    for q in ("abra", "cadabrac", "zzz abrab", "dabra acad", "bbbb", "", "a", "1a1", "abra" * 200):
        assert int(p.phrases([q])[0][0, 0]) == _phrases(text, q, langid.PIECE), q
    r = random.Random(4)
    text = "".join(r.choice("abcd ") for _ in range(3000)).replace("  ", " ")
    p = _parser(text)
    qs = ["".join(r.choice("abcde 1") for _ in range(r.randrange(700))) for _ in range(40)]
    assert p.phrases(qs)[0][:, 0].tolist() == [_phrases(text, q, langid.PIECE) for q in qs]


def test_many_letters_take_little_memory():
    r = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    p = _parser("".join(r.choice(letters) for _ in range(32_000)))
    p.ready()
    assert sum(x.nbytes for x in p.tables[0]) < 2_000_000
    base, owner, to, _ = p.tables[0]
    for s, c, n in p.edges[0].tolist():
        assert owner[base[s] + c] == s and to[base[s] + c] == n


def test_languages_of_long_documents_are_learned(spark):
    rows = [(i, ("kalomitu " if i % 2 else "schverung ") * 6000, "aa" if i % 2 else "bb") for i in range(12)] + [(50, "lomi kalo tuka", None), (51, "verung sch", None)]
    got = {x.doc_id: x.lang_pred for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50] == "aa" and got[51] == "bb"


def test_language_ties_go_to_the_more_frequent(spark):
    rows = [(i, "same text here", "many" if i % 3 else "few") for i in range(30)] + [(99, "same text", None)]
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"many"}


# 7 Licenses


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.txt", "plain words"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"),
        (4, "a/b/y.txt", None),
        (5, "z/y.txt", "the licence of poets"),
        (6, None, "Released under the MIT License."),
        (7, "a/b/q.txt", "x\nThis work is licensed under the GNU General Public License, version 3.\ny"),
        (8, "top.txt", ""),
        (9, "m/one.txt", "a long tale that only mentions, far into it, that it was once released under the MIT License, as tales are"),
        (10, "m/two.txt", "another tale"),
        (11, "n/whole.txt", "Licensed under CC BY-NC 4.0."),
        (12, "n/other.txt", "text"),
        (1, "a/LICENSE", "Released under the MIT License."),
    ]
    got = sorted((r.id, r.license, r.how) for r in licenses.scan(spark.createDataFrame([(*x, 0, "d") for x in rows], "id long, path string, text string, depth int, dir string")).collect())
    assert got == sorted([(1, "MIT", "own"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "own"), (4, "Apache-2.0", "inherited"), (5, None, "none"), (6, "MIT", "own"), (7, "GPL-3.0", "own"), (8, None, "none"), (9, "MIT", "own"), (10, None, "none"), (11, "CC-BY-NC-4.0", "own"), (12, "CC-BY-NC-4.0", "inherited"), (1, "MIT", "own")], key=lambda x: x[0])


def test_licenses_in_lines_headers_and_whole_texts():
    filler = "and so the story of the small house by the river went on for years"
    cases = {
        f"{filler}. Released under the MIT License. {filler}": "MIT",
        "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        "licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 2 of the License, or\n# (at your option) any later version.": "GPL-2.0",
        " * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License": "GPL-3.0",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "AGPL-3.0",
        "Released under the BSD 2-Clause License": "BSD-2-Clause",
        filler: None,
        "a licence to drive": None,
    }
    cases |= {text: name for name, _, _, text in licenses.WORDINGS}
    assert {t: licenses.best(t)[0] for t in cases} == cases


def test_wrapped_notices_pass_the_filter(spark):
    """Every wording with each blank a line end and a comment sign, through the query; and what its own text gives."""
    rows = [(i, f"d{i}/x.c", "\n * ".join(text.split())) for i, (_, _, _, text) in enumerate(licenses.WORDINGS)]
    rows += [(100, "e/LICENSE", "Permission\n * is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (101, "e/x/y.c", "int main"), (102, "f/z", "RELEASED\t\n under\u00a0the MIT License")]
    got = {r.id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {i: (licenses.best(t)[0], "own") for i, _, t in rows if i != 101} | {101: ("MIT", "inherited")}


def test_license_ties_go_to_the_longer_template_then_the_name():
    both = "Licensed under the MIT License. Released under the ISC License."
    assert licenses.best(both)[:2] == ("MIT", pytest.approx(1.0))
    assert licenses.best("Released under the ISC License. Licensed under the MIT License.")[:2] == licenses.best(both)[:2]


def test_license_cosine_by_definition():
    """Every window's cosine, from whole vectors over all terms."""
    known = licenses.templates()
    bags = [licenses.terms(w) for _, w, _, _ in known]
    every = sorted({t for b in bags for t in b}, key=str)
    held = {t: sum(t in b for b in bags) for t in every}

    def vector(words):
        b = licenses.terms(words)
        names = every + [t for t in b if t not in held]
        return {t: (1 + math.log(b[t])) * (math.log((len(known) + 1) / (held.get(t, 0) + 1)) + 1) for t in names if b[t]}

    assert all(must <= set(w) and not never & set(w) for _, w, must, never in known)
    for template in (0, 40, 100, len(known) - 1, len(known) - 5):
        words = list(known[template][1])
        words[len(words) // 2] = "otherwise" if words[len(words) // 2] not in known[template][2] else words[len(words) // 2]
        a, b = vector(words), vector(known[template][1])
        want = sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        assert licenses.cosine(tuple(words), template) == pytest.approx(want, abs=1e-8)


# 9 Token counts


def test_token_counts(spark, docs, tmp_path):
    log = str(tmp_path / "log")
    gone, new = docs.filter("doc_id = 3"), docs.filter("doc_id = 4")
    tokencounts.commit(tokencounts.deltas(docs, "words-1"), log, "b1")
    tokencounts.commit(tokencounts.deltas(gone, "words-1", sign=-1), log, "b2")
    tokencounts.commit(tokencounts.revision(new, new.withColumn("text", F.lit("two words")), ("words-1",), ("words-1",)), log, "b3")
    first = sorted(map(str, tokencounts.totals(spark, log).collect()))
    tokencounts.commit(tokencounts.deltas(gone, "words-1", sign=-1), log, "b2")
    # A crash after the data and before the manifest leaves a folder that nothing names.
    tokencounts.deltas(docs, "words-1").write.parquet(f"{log}/data/left-behind")
    assert sorted(map(str, tokencounts.totals(spark, log).collect())) == first
    tokencounts.compacted(spark, log, str(tmp_path / "small"))
    assert sorted(map(str, tokencounts.totals(spark, str(tmp_path / "small")).collect())) == first
    want = {}
    for r in docs.collect():
        if r.doc_id == 3:
            continue
        n = 2 if r.doc_id == 4 else len((r.text or "").split())
        a = want.setdefault((r.source, r.lang), [0, 0])
        a[0], a[1] = a[0] + 1, a[1] + n
    got = {(r.source, r.lang): [r.docs, r.tokens] for r in tokencounts.totals(spark, log).collect()}
    assert got == want
    assert tokencounts.totals(spark, str(tmp_path / "none")).count() == 0


def test_roll_up_counts_every_document(docs):
    want = {}
    for r in docs.collect():
        a = want.setdefault((r.source, r.lang), [0, 0, 0])
        a[0], a[1], a[2] = a[0] + 1, a[1] + len((r.text or "").split()), a[2] + len((r.text or "").encode())
    assert any(lang is None for _, lang in want)
    got = tokencounts.roll_up(docs).collect()
    assert {(r.source, r.lang): [r.docs, r.tokens, r.bytes] for r in got if r.tokenizer == "words-1"} == want
    assert {(r.source, r.lang): r.docs for r in got if r.tokenizer != "words-1"} == {k: v[0] for k, v in want.items()}
    assert {r.tokenizer for r in got} == set(tokencounts.TOKENIZERS)


def test_the_second_batch_revises_the_first(spark, tmp_path):
    """Each batch by itself: what was counted before, and every kind of change that the second takes to today's counts."""
    r = random.Random(3)
    d = spark.createDataFrame([(i, _words(r, r.randrange(1, 30)), "en", "ab"[i % 2]) for i in range(600)] + [(600, None, None, "a"), (601, "", "en", "a")], "doc_id long, text string, lang string, source string")
    log = str(tmp_path / "log")
    tokencounts.roll_up(d, log)
    draws = {x.text: x.draw for x in d.selectExpr("text", "pmod(xxhash64(coalesce(text, ''), 'counts'), 100) draw").collect()}
    assert min(draws.values()) < 5 and max(draws.values()) > 94 and any(4 < v < 15 for v in draws.values())
    want, now = {}, {}
    for x in d.collect():
        t, k = x.text or "", draws[x.text]
        old = [] if k < 5 else [t[: len(t) // 2]] if k < 15 else [t] * (1 + (k > 94))
        for texts, to in ((old, want), ([t], now)):
            for text in texts:
                a = to.setdefault((x.source, x.lang), [0, 0, 0, 0])
                for i, n in enumerate((1, len(text.split()), len(re.findall(r"\w+", text)), len(text.encode()))):
                    a[i] += n
    paths = {m.batch: m.path for m in tokencounts.manifest(spark, log).collect()}
    load = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens, x.bytes) for x in spark.read.parquet(paths["load"]).collect()}
    assert {k[:2]: v for k, v in load.items() if k[2] == "words-1"} == {k: (v[0], v[1], v[3]) for k, v in want.items()}
    assert {k[:2]: v for k, v in load.items() if k[2] == "words-0"} == {k: (v[0], v[2], v[3]) for k, v in want.items()}
    got = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens, x.bytes) for x in tokencounts.totals(spark, log).collect()}
    assert {k[:2]: v for k, v in got.items() if k[2] == "words-1"} == {k: (v[0], v[1], v[3]) for k, v in now.items()}
    assert not any(k[2] == "words-0" for k in got)


def test_bpe_counts(spark, docs):
    pytest.importorskip("tiktoken")
    with open(f"{tokencounts.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = tokencounts.encoding("x", f.read())
    want = {}
    for r in docs.withColumn("t", tokencounts.bpe(spark)("text")).collect():
        assert r.t == len(enc.encode_ordinary(r.text or "")) and enc.decode(enc.encode_ordinary(r.text or "")) == (r.text or "")
        want[r.source, r.lang] = want.get((r.source, r.lang), 0) + r.t
    assert {(r.source, r.lang): r.tokens for r in tokencounts.roll_up(docs).collect() if r.tokenizer == "byte_bpe_50k-1"} == want


# 10 Sharding


def test_sharding(docs):
    rows = docs.collect()
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in range(16):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16 for r in got)


def test_shards_are_near_equal(spark):
    r = random.Random(7)
    d = spark.createDataFrame([(i, _words(r, r.randrange(1, 60))) for i in range(5000)], "doc_id long, text string")
    by = [x.b for x in sharding.shard(d).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(by) == 16 and max(by) <= 1.01 * sum(by) / 16


def test_rebalancing_moves_little(spark, tmp_path):
    r = random.Random(1)
    weights = [(v, r.randrange(100, 1000)) for v in range(sharding.SLOTS)]
    one = sharding.first_map(weights, 16)
    grown = [(v, w * (3 if v % 16 == 0 else 1)) for v, w in weights]
    two = sharding.rebalanced(one, grown, 17)
    held = [sum(w for _, _, s, w in two if s == k) for k in range(17)]
    assert two[0][0] == 2 and max(held) <= 1.01 * sum(held) / 17
    moved = sum(w for (_, v, s, _), (_, _, t, w) in zip(one, two) if s != t)
    assert moved < 0.3 * sum(held)
    sharding.save_map(spark, one, str(tmp_path)), sharding.save_map(spark, two, str(tmp_path))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.save_map(spark, two, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 1).count() == sharding.SLOTS and sorted(map(tuple, sharding.load_map(spark, str(tmp_path), 2).collect())) == two


def test_equal_rows_fill_no_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 50)
    d = spark.createDataFrame([(None, "the same words")] * 4000 + [(i, f"row {i} of its own") for i in range(4000)], "doc_id long, text string")
    got = sharding.shard(d).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert len(got) == 8000 and len(by) == 16 and max(by.values()) <= 1.05 * sum(by.values()) / 16
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))


# All: edge cases in common


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.example/b/c.html?x=1", "<p>Released under the <b>MIT</b> License</p>"), (2, "https://a.example/b/d/e.html", "<p>text</p>"), (3, None, None), (4, "x", "")]
    return spark.createDataFrame([(*r, "i", "h") for r in rows], "page_id long, url string, html string, id string, how string")


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    """4,000 equal rows among 4,000 others, in 3 and in 7 partitions: the same place for every distinct row, the same counts."""
    monkeypatch.setattr(sharding, "EQUAL", 100)
    rows = [(7, "the same text")] * 4000 + [(1000 + i, f"text {i} " * (i % 50)) for i in range(4000)]
    random.Random(4).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sharding.shard(d.repartition(n)).select("doc_id", "size", "text_crc32", "shard", "slot").collect() for n in (3, 7)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))
    held = {}
    for r in runs[0]:
        held[r.shard] = held.get(r.shard, 0) + r.size
    assert len(held) == 16 and max(held.values()) - min(held.values()) < 0.02 * max(held.values())


def test_pages_inherit_by_their_addresses(docs, pages):
    got = {r.id: (r.license, r.how) for r in licenses.scan_documents(docs.limit(0), pages).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: (None, "none")}


def test_odd_rows_give_a_row_each(docs, labels, pages):
    n = docs.count()
    assert toxicity.score_toxicity(docs, labels).count() == n
    assert quality.classify(docs, labels).count() == n
    assert langid.identify(docs).count() == n
    assert simhash.simhash_components(docs).count() == n
    assert licenses.scan_documents(docs, pages).count() == n + 4
    assert decontamination.clean(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == n


def test_empty_tables(empty, labels):
    none = labels.limit(0)
    for df in (mixing.mix_sources(empty), mixing.mixed(empty), fingerprints.fingerprint(empty), simhash.simhash_components(empty), simhash.deduplicated(empty), toxicity.score_toxicity(empty, none), quality.classify(empty, none), langid.identify(empty), licenses.scan_documents(empty, empty.selectExpr("doc_id page_id", "text url", "text html")), tokencounts.roll_up(empty), sharding.shard(empty)):
        assert df.count() == 0


def test_nothing_to_learn(docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
