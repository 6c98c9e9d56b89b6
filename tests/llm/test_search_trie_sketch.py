"""Operators 11 to 13 on small fixtures, held against brute force, and their SQL on the smallest tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from weftwork.llm import negatives, oddsketch, prefixtrie, queries, setlinks
from weftwork.llm.simhash import components

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, uid long, norm double, cell int"
TURNS = "conv_id long, turn long, role string, text string, digest string, depth long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, h long, cell long"


def _plain(rows, columns):
    return sorted(str(tuple("~" if r[c] is None else str(r[c]) for c in columns)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.SQL[name])
    names = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(df.columns) == names
    got = [{c: round(v, 6) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in df.collect()]
    assert _plain(got, names) == _plain([{c: round(v, 6) if isinstance(v, float) else v for c, v in r.items()} for r in rows], names)


# 11 Hard negatives


def _mined(rows):
    """The contract, pair by pair, in whole numbers."""
    vs = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        vs.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, label, v) in enumerate(vs):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, m) for k, (i, m, w) in enumerate(vs) if k != n]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, i, rank, j, p, q) for rank, (q, j, _) in enumerate(inside, 1)]
    return out


def _vectors(n=700, seed=4, scale=0.2):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0.1, scale) * (1 + i % 5) for _ in range(8)], r.choice([0, 1, 1, 1, 2, 3, 9])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.1] * 8, None), (n + 2, [0.1] * 7 + [None], 1), (n + 3, [0.1] * 7 + [float("nan")], 1), (n + 4, [float("inf")] * 8, 2)]
    rows += [rows[0]] * 2 + [rows[17]] * 3 + [(None, rows[9][1], 1), (None, rows[21][1], 3), (n + 50, [], 1), (n + 100, [0.5, 0.25], 1), (n + 150, [0.0] * 8, 2)]
    return rows


@pytest.mark.parametrize("block, bucket", [(8192, 4096), (5, 16)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rows = _vectors()
    got = negatives.mine(spark.createDataFrame([(*x, 1, 0.5, 3) for x in rows], VECTORS)).collect()
    want = _mined(rows)
    assert len(want) > 100 and sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_ties_go_by_id_and_many_equal_rows_stay(spark):
    rows = [(i, [0.5, 0.25], 1 if i % 2 else 2) for i in range(101)] + [(1000 + i, [0.3, 0.1], 3) for i in range(40)]
    got = negatives.mine(spark.createDataFrame([(*x, 1, 0.5, 3) for x in rows], VECTORS)).collect()
    assert sorted(map(tuple, got)) == sorted(_mined(rows))


def test_large_components_score_exactly(spark):
    big = [(50 * i, [3e13 + 1e7 * i, 2e12, -1e6 * i], i % 2) for i in range(1, 9)] + [(3, [2e13, 1e12, 5.0], 0), (4, [2.5e13, 0.0, 1.0], 1)]
    kept = [(i, [x / 1e7 for x in v], label) for i, v, label in big]
    df = spark.createDataFrame([(i, v, label, 1, 0.5, 3) for i, v, label in kept], VECTORS)
    assert sorted(map(tuple, negatives.mine(df).collect())) == sorted(_mined(kept))


def test_norms_leave_buckets_out():
    """Short candidates behind long ones are never multiplied, and what they could not have changed stays right."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    v = r.integers(-100, 100, (600, 8)).astype("<i2")
    v[300:] //= 25
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-norm)
    window = pa.list_(pa.struct([("of", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    def batch(rows, kind):
        windows = [[{"of": 0, "low": None, "high": None}]] * len(rows)
        return pa.record_batch([pa.array([0] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array(rows), pa.array([1] * len(rows)), pa.array(rows), pa.array([v[i].tobytes() for i in rows]), pa.array([False] * len(rows)), pa.array(norm[rows]), pa.array(windows, window)], ["cell", "kind", "uid", "label", "id", "v", "wide", "norm", "windows"])

    seen = []
    take = negatives._Cell.take
    try:
        negatives._Cell.take = lambda self, c: seen.append(len(c)) or take(self, c)
        negatives.BUCKET, whole = 50, negatives.BUCKET
        found = list(negatives.search_cells(5, True)(iter([batch(order[:3], 0), batch(order, 1)])))
    finally:
        negatives._Cell.take, negatives.BUCKET = take, whole
    assert len(seen) < 10
    got = {(u, i) for b in found for u, i in zip(b.column("uid").to_pylist(), b.column("found_id").to_pylist())}
    for a in order[:3]:
        s = v.astype(int) @ v[a].astype(int)
        assert {i for u, i in got if u == a} == set(sorted((i for i in range(600) if i != a), key=lambda i: (-s[i], i))[:5])


# 12 Prefix trie


def _trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(path))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _conversations(n=160, seed=8):
    r = random.Random(seed)
    rows = []
    for c in list(range(n)) + [200, 305, 499, -3, -100]:
        for t in range(r.randrange(1, 7)):
            rows.append((c, t if t else None, r.choice(["user", "assistant", None, "us"]), r.choice(["", None, "a", "é", "er", "x" * 50])))
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "eit"), rows[4], rows[4], (None, 1, "user", "no conversation"), (600, None, None, None), (600, None, "ab", "c"), (600, None, "a", "bc")]
    return rows


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_trie_by_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = _conversations()
    got = prefixtrie.trie(spark.createDataFrame([(*x, "d", 3) for x in rows], TURNS))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _trie(rows)))


def test_trie_of_copies_and_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(3)] + [(5000, t, "user", str(t % 7)) for t in range(600)]
    assert sorted(map(str, map(tuple, prefixtrie.trie(spark.createDataFrame([(*x, "d", 3) for x in rows], TURNS)).collect()))) == sorted(map(str, _trie(rows)))


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone"), (900, 0, "user", "here")]
    got = {tuple(r) for r in prefixtrie.trie(spark.createDataFrame([(*x, "d", 3) for x in rows], TURNS)).collect()}
    assert got == set(_trie(rows)) and any(r[1] == 0 and r[3] == 2 for r in got)


# 13 Odd sketches


def _shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _linked(rows, p=85, q=100):
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(rows, sets, root)]


def _documents(n=70, seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("alder birch cedar dogwood elm fir ginkgo".split()) + str(r.randrange(400))
    rows, base = [], [[word() for _ in range(r.choice([6, 8, 20, 60, 200]))] for _ in range(n)]
    for w in base:
        rows.append(w)
        for _ in range(r.randrange(4)):
            copy = list(r.choice(rows[-3:]))
            for _ in range(r.randrange(1, 1 + max(1, len(copy) // 60))):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    rows = [(100 + i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(3, None), (4, ""), (5, " \n\t"), (6, "one two"), (7, "One\tTWO"), (8, "one two three"), (None, "no id in this row at all"), (None, None), (9, " ".join(word() for _ in range(20_000))), (None, rows[0][1].upper())]
    return rows + [rows[2]] * 3


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _documents()
    return rows, spark.createDataFrame([(*x, None, "s", 1, "n", 2, 3) for x in rows], DOCS)


@pytest.mark.parametrize("cell, shingles", [(4096, 1_000_000), (3, 300)])
def test_near_duplicates_by_brute_force(corpus, monkeypatch, cell, shingles):
    monkeypatch.setattr(oddsketch, "CELL", cell)
    monkeypatch.setattr(oddsketch, "SHINGLES", shingles)
    rows, docs = corpus
    got = oddsketch.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _linked(rows)))


def test_similarity_at_the_limit_links(spark):
    """17 of 20 shingles shared link at 0.85; 17 of 21 do not."""
    r = random.Random(1)
    for shared, more, linked in ((85, 15, True), (170, 30, True), (84, 16, False)):
        own = [f"w{r.randrange(10**9)}" for _ in range(shared + 4)]
        a, b = " ".join(own), " ".join(own + [f"v{r.randrange(10**9)}" for _ in range(more)])
        d = spark.createDataFrame([(1, a, None, "s", 1, "n", 2, 3), (2, b, None, "s", 1, "n", 2, 3)], DOCS)
        assert ({x.component_id for x in oddsketch.near_duplicates(d).collect()} == {1}) == linked


def test_odd_sketches_estimate_high_similarities():
    r = np.random.default_rng(3)
    for share in (0.95, 0.9, 0.85):
        errors = []
        for _ in range(40):
            both = r.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
            mine = [np.r_[both, r.integers(0, 1 << 63, int(500 * (1 - share)), dtype=np.uint64)] for _ in range(2)]
            drawn = oddsketch.samples(mine)
            s = oddsketch.odd_sketches(drawn)
            true = len(both) / (2 * len(mine[0]) - len(both))
            errors.append(float(oddsketch.estimate(s[0], s[1])) - true)
            assert np.bitwise_count(s[0] ^ s[1]).sum() <= oddsketch.CUT
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_samples_are_minima_over_runs(monkeypatch):
    r = np.random.default_rng(1)
    sets = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 7, 300, 2, 5)]
    want = oddsketch.samples(sets)
    monkeypatch.setattr(oddsketch, "RUN", 4)
    assert (oddsketch.samples(sets) == want).all()
    assert (want[2, 5] == ((sets[2] ^ oddsketch._FLIP[5]) * oddsketch._TIMES[5]).min()).all()


def _classes(n, links):
    root = list(range(n))
    for i, j in links:
        a, b = root[i], root[j]
        root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("similar", [(85, 100), (4, 5)])
def test_similar_forest_by_brute_force(similar):
    r, p, q = np.random.default_rng(7), *similar
    for _ in range(30):
        base = [r.choice(4000, r.integers(1, 60), replace=False) for _ in range(6)]
        sets = []
        for _ in range(40):
            s = set(base[r.integers(6)].tolist())
            s ^= set(r.choice(4000, r.integers(0, 8), replace=False).tolist())
            sets.append(np.array(sorted(s), dtype=np.uint64))
        label = np.arange(40)
        label[:4] = 0
        pairs = [(i, j) for i in range(40) for j in range(i) if q * len(np.intersect1d(sets[i], sets[j])) >= p * len(np.union1d(sets[i], sets[j])) > 0]
        got = setlinks.similar_forest(sets, similar, label)
        assert all((i, j) in pairs or (j, i) in pairs for i, j in got)
        tied = [(0, 1), (0, 2), (0, 3)]
        same = lambda x: [[a == b for b in x] for a in x]
        assert same(_classes(40, got + tied)) == same(_classes(40, pairs + tied))


def test_common_parts_cost_little():
    """6,000 sets that share 200 elements and have 80 of their own never meet; 6,000 near copies are joined by one of them."""
    import time

    r = np.random.default_rng(5)
    common = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    apart = [np.r_[common, r.integers(0, 1 << 63, 80, dtype=np.uint64)] for _ in range(6000)]
    near = [np.r_[common, r.integers(0, 1 << 63, 8, dtype=np.uint64)] for _ in range(6000)]
    began = time.time()
    assert setlinks.similar_forest(apart, (4, 5)) == []
    assert len(setlinks.similar_forest(near, (4, 5))) == 5999
    assert time.time() - began < 6


def test_links_of_large_groups_by_brute_force(spark):
    """Groups over the bound: leaders, the largest class against the rest, and no link lost."""
    r = random.Random(9)
    sets = []
    for g in range(3):
        base = [f"{g}-{i}" for i in range(60)]
        for _ in range(60):
            s = set(base)
            for _ in range(r.choice([1, 3, 5, 9])):
                s ^= {f"{g}-{r.randrange(90)}"}
            sets.append((g, np.array(sorted(int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in s), dtype=np.uint64)))
    rows = spark.createDataFrame([(g, i, len(s), bytearray(s.tobytes())) for i, (g, s) in enumerate(sets)], "cell long, node long, weight long, load binary")
    got = [(x.u, x.v) for x in setlinks.links_within(rows, 600, setlinks.set_alike((4, 5)), setlinks.set_forest((4, 5)), components).collect()]
    pairs = [(i, j) for i, (g, s) in enumerate(sets) for j, (h, t) in enumerate(sets[:i]) if g == h and 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t))]
    assert all((i, j) in pairs or (j, i) in pairs for i, j in got) and len(got) < len(pairs) / 3
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(_classes(len(sets), got)) == same(_classes(len(sets), pairs))


def test_empty_tables(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert oddsketch.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
