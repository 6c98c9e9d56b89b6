"""Operator 4, benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

Texts are sequences of symbols: words (runs of ASCII letters, digits and other characters over 0x7F; A-Z lowered), and single
characters of scripts that put no spaces between words. A CGK walk reads a window: at each step it emits the symbol it stands
on, then stays or moves on by a random bit of that symbol and step, so windows at a small edit distance emit sequences at a
small Hamming distance. Each of WALKS walks is sampled at SAMPLED of its STEPS; the windows of a text, one at each symbol, and
of each benchmark item are alike if they agree in all sampled steps of one walk. An item that is alike somewhere is a
candidate for the whole text. Most candidates go by counting (a part that is near enough to the item holds most of its
symbols); the others are verified: the least edit distance, in symbols, between the whole item and any part of the text.

Windows end where a walk does, after four or five symbols, not at the item's end: CGK distances grow with the square of the
edits, so whole items at the limit of a fifth agree in too few steps for any number of walks to be afforded (figures in the
README). Items under LEAST symbols are too short for walks and are found without loss: where no edit is allowed by their whole
sequence, where one is by the sequences that are left when one symbol goes, of the item and of the text's windows one shorter,
as long and one longer (two sequences one edit apart share one of these).

Nulls and edges: a null text matches nothing; an item without a symbol matches nothing; items of equal symbols match alike; an
empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import LETTERS_DIGITS, mix, ranges, raw, slices, word_hashes, words

#: An item is found where at least this share of its symbols needs no edit; items of fewer symbols are looked up whole.
SIMILAR, LEAST = 0.8, 8
#: Walks, steps of one, steps sampled from it, and places that these must see for a window of an item to get a key. Tests
#: measure the recall at the limit: 0.95 or more for every kind of edit and every length.
WALKS, STEPS, SAMPLED, SEEN = 14, 8, 5, 4
#: Symbols of benchmark items that are searched for in one pass over the documents, at most, but for one item that is longer by
#: itself; candidates' symbols counted at once.
BLOCK, COUNTED = 500_000, 1 << 20
# Code points of scripts without spaces between words, first and last.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
# Punctuation over 0x7F that is part of no word, first and last.
PUNCTUATION = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20))

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("edits", T.IntegerType()), T.StructField("start_word", T.IntegerType())]))


def _within(points: np.ndarray, spans: tuple) -> np.ndarray:
    out = np.zeros(len(points), dtype=bool)
    for a, b in spans:
        out |= (points >= a) & (points <= b)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes of all texts and at which symbol each text begins (with the end at last)."""
    data, at = raw(texts)
    wide = np.flatnonzero(data >= 0xE0)
    if not len(wide):
        begins, ends, first = words(data, at, LETTERS_DIGITS)
        return word_hashes(data, begins, ends), first
    # Code points of three and four bytes: punctuation becomes blanks, characters of unspaced scripts stand alone.
    tail = [data[np.minimum(wide + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    lead, four = data[wide].astype(np.int64), data[wide] >= 0xF0
    points = np.where(four, (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], (lead & 15) << 12 | tail[0] << 6 | tail[1])
    size = np.where(four, 4, 3)
    blank = _within(points, PUNCTUATION)
    if blank.any():
        data = data.copy()
        data[ranges(wide[blank], wide[blank] + size[blank])] = 0x20
    alone = _within(points, UNSPACED)
    begins, ends, first = words(data, at, LETTERS_DIGITS, np.unique(np.concatenate([wide[alone], (wide + size)[alone]])))
    return word_hashes(data, begins, ends), first


def walk_keys(symbols: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol, the key of the walk that starts on it, the last symbol that the key depends on, and how many it has."""
    sampled = sorted(np.random.default_rng(walk).choice(np.arange(1, STEPS), SAMPLED - 1, replace=False).tolist())
    coins = mix(symbols ^ np.uint64(0x5851F42D4C957F2D * (walk + 1) % (1 << 64)))
    wide, bits = np.r_[symbols, np.zeros(STEPS, np.uint64)], np.r_[coins, np.zeros(STEPS, np.uint64)].astype(np.uint8)
    at = np.arange(len(symbols), dtype=np.int32)
    keys, before, seen = mix(symbols + np.uint64(walk)), at, np.ones(len(symbols), dtype=np.int8)
    for step in range(sampled[-1]):
        at = at + ((bits[at] >> np.uint8(step)) & np.uint8(1))
        if step + 1 in sampled:
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + wide[at]
            seen += at != before
            before = at
    return mix(keys), at, seen


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and where that part ends (Sellers), by rows of numpy."""
    slope = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, symbol in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != symbol))
        row = np.minimum.accumulate(np.r_[i, new] - slope) + slope
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Items:
    """One block of distinct benchmark items (ids of each, symbols) with the keys of all their windows, sorted, for each walk."""

    ids: list[list[int | None]]
    words: list[np.ndarray]
    similar: float = SIMILAR
    keys: list[np.ndarray] = field(init=False)
    owners: list[np.ndarray] = field(init=False)
    #: Items that no walk has a key for: candidates everywhere.
    bare: np.ndarray = field(init=False)
    #: Symbols of the short items by length: their sequences, sorted, as numbers, and the item of each.
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)
    #: Short items that one edit is allowed in: by length, the numbers of their sequences, whole and less one symbol, and items.
    lacking: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)
    #: Made where they are used.
    tables: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.symbols = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.size)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        self.keys, self.owners = [], []
        known = self.size < LEAST
        for walk in range(WALKS):
            keys, last, seen = walk_keys(self.symbols, walk)
            inside = np.flatnonzero((last < self.ends[owner]) & (seen >= SEEN) & (self.size[owner] >= LEAST)) if len(owner) else np.zeros(0, np.int64)
            known[owner[inside]] = True
            order = inside[np.lexsort((owner[inside], keys[inside]))]
            key, mine = keys[order], owner[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (mine[1:] != mine[:-1])] if len(key) else np.zeros(0, bool)
            self.keys.append(key[once])
            self.owners.append(mine[once])
        self.short, less = {}, {}
        for n in range(1, LEAST):
            mine = np.flatnonzero(self.size == n)
            allowed = int(self.most(mine[:1])[0]) if len(mine) else 0
            if allowed > 1:
                known[mine] = False
            elif allowed:
                for i in mine.tolist():
                    for length, numbers in ((n, _sequences(self.words[i], n)), (n - 1, _lacking(self.words[i], n).ravel())):
                        less.setdefault(length, []).append((numbers, np.full(len(numbers), i)))
            elif len(mine):
                whole = np.array([_sequences(self.words[i], n)[0] for i in mine.tolist()], dtype=np.uint64)
                order = np.argsort(whole)
                self.short[n] = whole[order], mine[order]
        self.lacking = {}
        for length, parts in less.items():
            numbers, items = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((items, numbers))
            self.lacking[length] = numbers[order], items[order]
        self.bare = np.flatnonzero(~known)

    def candidates(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item) with a window alike. Equal keys of a text count once, however often the text has them."""
        if self.tables is None:
            self.tables = np.zeros((len(self.keys), 1 << 20), dtype=bool)
            for table, keys in zip(self.tables, self.keys):
                table[keys >> np.uint64(44)] = True
        texts, many = np.flatnonzero(np.diff(first)), len(self.words)
        found = [(texts[:, None] * many + self.bare).ravel()]
        for walk, (sorted_keys, owners) in enumerate(zip(self.keys, self.owners)):
            if not len(sorted_keys):
                continue
            keys, _, _ = walk_keys(symbols, walk)
            # A table of the keys' first 20 bits turns most windows away.
            maybe = np.flatnonzero(self.tables[walk][keys >> np.uint64(44)])
            low = np.searchsorted(sorted_keys, keys[maybe], "left")
            hit = sorted_keys[np.minimum(low, len(sorted_keys) - 1)] == keys[maybe]
            text = np.searchsorted(first, maybe[hit], side="right") - 1
            pair = np.unique(text * len(sorted_keys) + low[hit])
            text, low = pair // len(sorted_keys), pair % len(sorted_keys)
            high = np.searchsorted(sorted_keys, sorted_keys[low], "right")
            found.append(np.unique(np.repeat(text, high - low) * many + owners[ranges(low, high)]))
        for length, (numbers, items) in self.lacking.items():
            for span, runs in [(length, _sequences(symbols, length)), *((length + 1, r) for r in _lacking(symbols, length + 1))]:
                low = np.searchsorted(numbers, runs, "left")
                place = np.flatnonzero(numbers[np.minimum(low, len(numbers) - 1)] == runs)
                text = np.searchsorted(first, place, side="right") - 1
                inside = place + span <= first[text + 1]
                place, text = place[inside], text[inside]
                high = np.searchsorted(numbers, runs[place], "right")
                found.append(np.repeat(text, high - low[place]) * many + items[ranges(low[place], high)])
        pair = np.unique(np.concatenate(found))
        return np.stack([pair // max(many, 1), pair % max(many, 1)], axis=1)

    def likely(self, pairs: np.ndarray, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of the pairs, those whose text holds as many of the item's symbols as a match leaves unedited."""
        texts, mine = np.unique(pairs[:, 0], return_inverse=True)
        places = ranges(first[texts], first[texts + 1])
        salt = mix(np.arange(1, len(texts) + 1).astype(np.uint64))
        held = np.unique(symbols[places] ^ np.repeat(salt, first[texts + 1] - first[texts]))
        keep, size = np.zeros(len(pairs), dtype=bool), self.size[pairs[:, 1]]
        ends = np.cumsum(size)
        at = 0
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, side="right")))
            item = pairs[at:to, 1]
            key = self.symbols[ranges(self.ends[item] - self.size[item], self.ends[item])] ^ np.repeat(salt[mine[at:to]], size[at:to])
            there = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            keep[at:to] = np.add.reduceat(there, np.r_[0, np.cumsum(size[at:to])[:-1]]) >= size[at:to] - self.most(item)
            at = to
        return pairs[keep]

    def most(self, item):
        """Edits that a match of an item may have."""
        return ((1 - self.similar) * self.size[item] + 1e-9).astype(np.int64)

    def verified(self, item: int, text: np.ndarray) -> tuple[int, int] | None:
        """Least edits between the item and any part of the text, and where that part begins, about; null if over the limit.

        Only parts that hold enough of the item's symbols are looked at, each stretch of them once.
        """
        size, most = int(self.size[item]), int(self.most(np.array([item]))[0])
        sums = np.r_[0, np.cumsum(np.isin(text, self.words[item]))]
        span = size + most
        starts = np.arange(max(1, len(text) - span + 1))
        good = starts[sums[np.minimum(starts + span, len(text))] - sums[starts] >= size - most]
        best = None
        for part in np.split(good, np.flatnonzero(np.diff(good) > span) + 1) if len(good) else ():
            a, b = int(part[0]), min(int(part[-1]) + span, len(text))
            edits, end = least_edits(self.words[item], text[a:b])
            if edits <= most and (best is None or edits < best[0]):
                best = edits, max(a + end - size, 0)
        return best

    def search(self, symbols: np.ndarray, first: np.ndarray) -> list[list[tuple]]:
        """For each text, (item_id, similarity, edits, start_word) of every item it holds, by item."""
        out: list[list[tuple]] = [[] for _ in range(len(first) - 1)]
        if not len(symbols):
            return out
        pairs = self.candidates(symbols, first)
        for text, item in (self.likely(pairs, symbols, first) if len(pairs) else pairs).tolist():
            if hit := self.verified(item, symbols[first[text] : first[text + 1]]):
                out[text] += [(i, 1 - hit[0] / int(self.size[item]), *hit) for i in self.ids[item]]
        for n, (whole, items) in self.short.items():
            runs = _sequences(symbols, n)
            low = np.searchsorted(whole, runs)
            for place in np.flatnonzero(whole[np.minimum(low, len(whole) - 1)] == runs).tolist():
                text = int(np.searchsorted(first, place, side="right")) - 1
                item = int(items[low[place]])
                if place + n <= first[text + 1] and not any(m[0] == self.ids[item][0] and m[2] == 0 for m in out[text]) and np.array_equal(symbols[place : place + n], self.words[item]):
                    out[text] += [(i, 1.0, 0, place - int(first[text])) for i in self.ids[item]]
        return out


def _sequences(symbols: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n symbols."""
    out = np.zeros(max(len(symbols) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + len(out)]
    return out


def _lacking(symbols: np.ndarray, n: int) -> np.ndarray:
    """The numbers of each run of n symbols without its first, without its second and so on: a row for each symbol that goes."""
    count, base = max(len(symbols) - n + 1, 0), 0x9E3779B97F4A7C15
    head = [_sequences(symbols, k) for k in range(n)]
    out = np.zeros((n, count), dtype=np.uint64)
    for k in range(n):
        after = n - 1 - k
        out[k] = head[k][:count] * np.uint64(pow(base, after, 1 << 64)) + head[after][k + 1 : k + 1 + count]
    return out


def blocks(benchmark: DataFrame, similar: float = SIMILAR, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark as blocks of about `block` symbols, split by a hash, so that what is sent to the executors is bounded."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A symbol has two bytes at least, a letter and a blank.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // (2 * block))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        symbols, first = tokens(part["text"].combine_chunks()) if len(part) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        ids: dict[bytes, list[int | None]] = {}
        for item, a, b in zip(part["item_id"].to_pylist(), first[:-1], first[1:]):
            if b > a:
                ids.setdefault(symbols[a:b].tobytes(), []).append(item)
        yield Items(list(ids.values()), [np.frombuffer(w, dtype=np.uint64) for w in ids], similar)


def matches_udf(docs: DataFrame, items: Items):
    """Column function text -> the items of one block that it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    @arrow_udf(MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        items, out = sent.value, []
        for a, b in slices(texts, 1 << 19):
            out += items.search(*tokens(texts[a:b]))
        return pa.array([[dict(zip(("item_id", "similarity", "edits", "start_word"), m)) for m in ms] for ms in out], pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("edits", pa.int32()), ("start_word", pa.int32())])))

    return matches


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, edits, start_word): a row for each benchmark item that a document holds."""
    out = None
    for items in blocks(benchmark, similar):
        found = docs.select("doc_id", F.explode(matches_udf(docs, items)("text")).alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, edits int, start_word int")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, unchanged, that hold no benchmark item."""
    for items in blocks(benchmark, similar):
        docs = docs.filter(F.size(matches_udf(docs, items)("text")) == 0)
    return docs
