"""The whole pipeline against a stage by stage brute-force version, on odd rows and on empty tables."""

import random
import zlib

import corpus_pipeline
from weftwork.llm import mixing, quality

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"


def _words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def _tables(spark, path):
    r = random.Random(21)
    items = [(i, _words(r, r.randrange(8, 20))) for i in range(6)] + [(50, None), (51, "Brevity")]
    rows = []
    for i in range(240):
        text = _words(r, r.randrange(8, 60))
        if i % 3 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 11 == 0:
            text = f"{text} {items[i % 6][1]} {_words(r, 5)}"
        elif i % 13 == 0:
            text = rows[-2][1] or ""
        elif i % 17 == 0:
            w = (rows[-1][1] or "a b").split()
            w[-1] = "altered"
            text = " ".join(w)
        rows.append((i, text, "en", "abc"[i % 3] if i % 7 else None))
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n", None, "b"), (303, _words(r, 20_000), "en", "c"), (None, _words(r, 30), "en", "a"), (None, None, None, None), (304, "such brevity", "en", "b")]
    rows += [rows[1]] * 3
    docs = [(*x, len(x[1] or ""), "k", 7) for x in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def _shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _groups(texts):
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            alike = sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
            if alike and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def _leaks(text, items):
    symbols = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
    for _, item in items:
        w = (item or "").lower().split()
        row = [0] * (len(symbols) + 1)
        for n, p in enumerate(w, 1):
            new = [n]
            for j, q in enumerate(symbols, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        if w and min(row) <= int(0.2 * len(w) + 1e-9):
            return True
    return False


def test_pipeline_by_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs, items = _tables(spark, path)
    table = spark.read.parquet(f"{path}/documents.parquet")
    scores = quality.score_udf(quality.train(table, spark.read.parquet(f"{path}/labels.parquet")))
    good = {(r.doc_id, r.text) for r in table.withColumn("s", scores("text")).collect() if r.s >= quality.ACCEPT}
    kept = [d for d in docs if (d[0], d[1]) in good]
    assert 100 < len(kept) < len(docs) - 50
    least = {}
    for root, d in zip(_groups([d[1] for d in kept]), kept):
        least[root] = min(least.get(root, d), d, key=lambda d: (d[0] is None, d[0] or 0))
    kept = [d for d in least.values() if not _leaks(d[1], items)]
    assert len(kept) < len(least)
    want = {}
    for r in mixing.copies(spark.createDataFrame(kept, DOCS)).collect():
        want[str(r.doc_id)] = want.get(str(r.doc_id), 0) + r.copies
    got = corpus_pipeline.run(spark, path).collect()
    count = {}
    for r in got:
        count[str(r.doc_id)] = count.get(str(r.doc_id), 0) + 1
    assert count == {k: v for k, v in want.items() if v}
    texts = {d[0]: d[1] or "" for d in kept}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for r in got if r.doc_id is not None)
    for s in range(16):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))


def test_pipeline_on_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
