"""Operator 6, language ID: cross-parsing entropy against a suffix automaton of labelled text for each language.

A text is parsed into the longest phrases that occur in a language's labelled text (the automaton walked from its start; a
phrase ends where no transition fits, or with the text); the language that needs the fewest phrases a letter wins. The
automata come from a bounded sample (CHARS characters a language, of about DOCS documents drawn by hash, both parameters of
`identify`; a document longer than what is left is cut there) and are kept as double arrays, whose size follows their
transitions, not the alphabet. A batch of texts is cut into pieces of PIECE characters that all step through the automata
together in numpy, whole texts included, at most one more phrase a piece.

Nulls and edges: a null text, or one without letters, gives `und` and score 0; ties go to the language with more labelled
documents, then by name; with nothing to learn from, every text gives `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.llm.common import doc_crc, slices, small

#: Characters of labelled text for each language, at most; labelled documents looked at for it, about; piece length.
CHARS, DOCS, PIECE = 32_000, 60, 256
#: Character ids: end of a piece, anything but a letter, a letter of no language.
PAD, GAP, ALIEN = 0, 1, 2


def letters_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), dtype=bool, count=sys.maxunicode + 1)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, built online; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def packed(edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array of transitions (state, letter, next): state s has its letter c at base[s] + c, where owner tells s.

    States with several letters are fitted first, largest first, each at or after the one before; those with one letter take
    the places that are left.
    """
    states = int(edges[:, [0, 2]].max()) + 1 if len(edges) else 1
    base = np.full(states, -1, dtype=np.int64)
    order = np.lexsort((edges[:, 1], edges[:, 0]))
    state, letter, next_ = edges[order].T if len(edges) else np.zeros((3, 0), dtype=np.int64)
    begin, size = np.searchsorted(state, np.arange(states)), np.bincount(state, minlength=states)
    free = np.ones(2 * len(state) + 2 * width + 64, dtype=bool)
    low = 0
    for s in np.argsort(-size, kind="stable").tolist():
        if size[s] < 2:
            break
        letters = letter[begin[s] : begin[s] + size[s]]
        at = low
        while True:
            # A window of bases at once: those where all letters fall on free places.
            if at + 256 + width > len(free):
                free = np.r_[free, np.ones(len(free) + 256 + width, dtype=bool)]
            fits = np.logical_and.reduce([free[at + c : at + c + 256] for c in letters.tolist()])
            if fits.any():
                break
            at += 256
        base[s] = at + int(fits.argmax())
        free[base[s] + letters] = False
        low = at  # the next state is not tried below: states of one letter will fill what is left there
    single = np.flatnonzero(size == 1)
    need = len(single) + width
    if len(holes := np.flatnonzero(free[width:]) + width) < need:
        holes = np.r_[holes, np.arange(len(free), len(free) + need)]
    base[single] = holes[: len(single)] - letter[begin[single]]
    base[size == 0] = 0
    length = int(max(base.max() + width, (base[state] + letter).max(initial=0))) + 1
    owner, to = np.full(length, -1, dtype=np.int32), np.zeros(length, dtype=np.int32)
    owner[base[state] + letter], to[base[state] + letter] = state, next_
    return base.astype(np.int32), owner, to


@dataclass
class Parsers:
    """langs by falling number of labelled documents; alphabet: the letters, from id ALIEN + 1; edges (state, id, next) of each."""

    langs: list[str]
    alphabet: str
    edges: list[np.ndarray]

    def __post_init__(self) -> None:
        self.tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tables": None, "ids": None}

    def ready(self) -> None:
        """Double arrays and the transitions of the start, once a Python worker. A piece's end (PAD) leads nowhere."""
        if self.tables is not None:
            return
        width = ALIEN + 1 + len(self.alphabet)
        self.ids = np.where(letters_table(), ALIEN, GAP).astype(np.int32)
        self.ids[[ord(c) for c in self.alphabet]] = np.arange(ALIEN + 1, width)
        self.tables = []
        for e in self.edges:
            first = np.zeros(width, dtype=np.int32)
            first[e[e[:, 0] == 0, 1]] = e[e[:, 0] == 0, 2]
            self.tables.append((*packed(e, width), first))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) phrase counts, and the letters of each text."""
        self.ready()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        ids = self.ids[points]
        owner = np.repeat(np.arange(len(texts)), size)
        # A run of other characters in a text counts once.
        keep = np.r_[True, (ids[1:] != GAP) | (ids[:-1] != GAP) | (owner[1:] != owner[:-1])] if len(ids) else np.zeros(0, bool)
        ids, owner = ids[keep], owner[keep]
        letters = np.bincount(owner[ids != GAP], minlength=len(texts))
        size = np.bincount(owner, minlength=len(texts))
        pieces = -(-size // PIECE)
        whose = np.repeat(np.arange(len(texts)), pieces)
        start, place = np.cumsum(size) - size, np.cumsum(pieces) - pieces
        grid = np.zeros((int(pieces.sum()), PIECE), dtype=np.int32)
        inside = np.arange(len(ids)) - start[owner]
        grid[place[owner] + inside // PIECE, inside % PIECE] = ids
        columns = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        for k, (base, owner, to, first) in enumerate(self.tables):
            at, ends = np.zeros(len(grid), dtype=np.int32), np.zeros(len(grid), dtype=np.int32)
            for column in columns:
                place = base[at] + column
                on = owner[place] == at
                # A phrase ends where there is no transition, at a piece's end too; the next one begins with this letter.
                ends += ~on & (at > 0)
                ends += ~on & (first[column] == 0) & (column > PAD)
                at = np.where(on, to[place], first[column])
            out[:, k] = np.bincount(whose, ends + (at > 0), len(texts))
        return out, letters


def train(docs: DataFrame, chars: int = CHARS, drawn: int = DOCS) -> Parsers:
    """Parsers from documents with a language whose crc32(doc_id as text) mod 3 is not 1.

    A threshold on a hash of doc_id keeps about `drawn` documents a language, however many there are; of these, documents are
    taken in hash order until there are `chars` characters, the last one in part.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % 3 != 1))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / (1 << 20)
    rows = known.join(small(counts.withColumnRenamed("lang", "of")), (F.col("lang") == F.col("of")) & (draw < F.lit(drawn) / F.col("n")))
    rows = rows.select("lang", "n", F.substring("text", 1, chars).alias("text"), draw.alias("draw"), "doc_id").distinct().collect()
    found = {r.lang: r.n for r in rows}
    langs = sorted(found, key=lambda x: (-found[x], x))
    taken: dict[str, list[str]] = {x: [] for x in langs}
    for r in sorted(rows, key=lambda r: (r.draw, r.doc_id, r.text)):
        left = chars - sum(map(len, taken[r.lang]))
        if left > 0:
            taken[r.lang].append(r.text[:left].lower())
    alphabet = "".join(sorted({c for ts in taken.values() for t in ts for c in t if c.isalpha()}))
    ids = {c: ALIEN + 1 + i for i, c in enumerate(alphabet)}
    edges = []
    for x in langs:
        symbols: list[int] = []
        for t in taken[x]:
            for c in t + " ":
                s = ids.get(c, GAP)
                if s != GAP or not symbols or symbols[-1] != GAP:
                    symbols.append(s)
        edges.append(np.array([(s, c, n) for s, row in enumerate(automaton(symbols)) for c, n in row.items()], dtype=np.int32).reshape(-1, 3))
    return Parsers(langs, alphabet, edges)


def predict_udf(docs: DataFrame, parsers: Parsers):
    """Column function text -> struct(lang_pred, score). The sent edges are bounded by CHARS a language."""
    sent = docs.sparkSession.sparkContext.broadcast(parsers)

    @arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        parsers = sent.value
        names, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for a, b in slices(texts, 1 << 20) if parsers.langs else ():
            phrases, letters = parsers.phrases([t.lower() for t in pa.compute.fill_null(texts[a:b], "").to_pylist()])
            rows = np.flatnonzero(letters)
            best = phrases[rows].argmin(axis=1)
            # A phrase more makes a language e times less likely.
            less = phrases[rows] - phrases[rows, best][:, None]
            names[a + rows] = np.array(parsers.langs, dtype=object)[best]
            scores[a + rows] = 1 / np.exp(-less.astype(float)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, chars: int = CHARS, drawn: int = DOCS) -> DataFrame:
    """doc_id, held_out (its language was not learned from), lang_pred, score."""
    predict = predict_udf(docs, train(docs, chars, drawn))
    return docs.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
