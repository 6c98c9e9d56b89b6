"""News entries: scoring against a project's words, listing, adding, purging and updating the store."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from weftwork.functions.text import any_of, has_word
from weftwork.functions.urls import is_blocked, is_homepage, is_self_reference


@dataclass(frozen=True)
class Project:
    """A project's words, from its configuration; a handful each."""

    key: str
    taboo: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    rivals: tuple[str, ...] = ()


# The weights of a score.
BASE, PER_WORD, WORDS_MOST, ENGINES, LONG, LONG_BYTES, CITY, CITY_PART, RIVAL, SOURCE = 50, 5, 25, 10, 5, 100, 10, 5, 5, 10


def _count(conditions) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def score(project: Project, title: Column, snippet: Column, url: Column, source: Column, engines: Column) -> Column:
    """0 for rejected entries (blocked, homepage, the project's own, taboo); else base, bonuses and penalties."""
    t, s = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(snippet, F.lit(""))
    both = F.concat(t, F.lit(" "), F.lower(s))
    reject = is_blocked(url) | is_homepage(url) | is_self_reference(source, F.lit(project.key)) | any_of(has_word(t, w.lower()) for w in project.taboo)
    city = F.coalesce(*[F.when(has_word(t, c.lower()), CITY).when(F.contains(t, F.lit(c.lower())), CITY_PART) for c in project.cities], F.lit(0))
    low = F.lower(F.coalesce(source, F.lit("")))
    known = any_of((low == g.lower()) | low.endswith("." + g.lower()) for g in project.sources)
    total = F.lit(BASE) + F.least(F.lit(WORDS_MOST), PER_WORD * _count(has_word(both, w.lower()) for w in project.positive))
    total = total + F.when(engines > 1, ENGINES).otherwise(0) + F.when(F.octet_length(s) > LONG_BYTES, LONG).otherwise(0)
    total = total + city - RIVAL * _count(has_word(t, r.lower()) for r in project.rivals) + F.when(known, SOURCE).otherwise(0)
    return F.when(F.coalesce(reject, F.lit(False)), 0).otherwise(total).cast("int")


#: Different words of all projects up to which one automaton holds them all.
WORDS = 200_000
#: What a text's walk tells of a word: it stands in the title, as a word of its own; or so in title and snippet together.
IN_TITLE, WORD_IN_TITLE, WORD = 1, 2, 4


def _walk(words: list[str]):
    """Column function (title, whole text, both lowered) -> map from each word found to what is told of it, by one walk a text
    through an Aho-Corasick automaton of all words."""

    def inked(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalpha() or text[at].isdecimal())

    @arrow_udf("map<string, int>")
    def found(titles: pa.Array, texts: pa.Array) -> pa.Array:
        known = ahocorasick.Automaton()
        for w in words:
            known.add_word(w, w)
        known.make_automaton()
        out = []
        for title, text in zip(titles.to_pylist(), texts.to_pylist()):
            told: dict[str, int] = {}
            for end, w in known.iter(text or "") if words else ():
                start = end - len(w) + 1
                whole = not inked(text, start - 1) and not inked(text, end + 1)
                inside = end < len(title)
                # A word at the title's end stands alone there whatever follows: a blank does.
                told[w] = told.get(w, 0) | (IN_TITLE if inside else 0) | (WORD_IN_TITLE if inside and whole else 0) | (WORD if whole else 0)
            out.append(list(told.items()))
        return pa.array(out, pa.map_(pa.string(), pa.int32()))

    return found


def scored(entries: DataFrame, config: DataFrame) -> DataFrame:
    """entries with the score of each against its own project; null without such a project.

    entries: project, title, snippet, url, source, engines. config: project, taboo_words, positive_words, good_sources,
    city_names, rival_cities, a row a project. All projects' different words are looked for in one walk a text, if there are no more
    than WORDS; else each entry is held against the words of its project alone. The project's row comes to the entry by an
    equi-join, and the rules are expressions over what was found.
    """
    lists = ("taboo_words", "positive_words", "good_sources", "city_names", "rival_cities")
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    config = config.select("project", *[lower(c).alias(f"_{c}") for c in lists])
    looked_for = F.array_distinct(F.concat(*[F.col(f"_{c}") for c in lists if c != "good_sources"]))
    words = config.select(F.explode(looked_for).alias("w")).filter("w != ''").distinct()
    t, s = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("snippet", F.lit(""))
    j = entries.withColumns({"_t": t, "_b": F.concat(t, F.lit(" "), F.lower(s))})
    few = [r.w for r in words.limit(WORDS + 1).collect()]
    if len(few) <= WORDS:
        j = j.withColumn("_found", _walk(few)("_t", "_b")).join(config, "project", "left")
    else:
        quoted = lambda w: F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        edge = lambda c, w: F.regexp_like(c, F.concat(F.lit(r"(?<![\p{L}\p{Nd}])\Q"), quoted(w), F.lit(r"\E(?![\p{L}\p{Nd}])")))
        told = lambda w: F.when(F.contains(F.col("_t"), w), IN_TITLE).otherwise(0) + F.when(edge(F.col("_t"), w), WORD_IN_TITLE).otherwise(0) + F.when(edge(F.col("_b"), w), WORD).otherwise(0)
        j = j.join(config, "project", "left")
        j = j.withColumn("_found", F.map_from_entries(F.transform(F.filter(looked_for, lambda w: w != ""), lambda w: F.struct(w.alias("k"), told(w).alias("v")))))
    has = lambda w, bit: (w != "") & (F.coalesce(F.try_element_at("_found", w), F.lit(0)).bitwiseAND(bit) > 0)
    count = lambda c, bit: F.size(F.filter(f"_{c}", lambda w: has(w, bit)))
    reject = is_blocked(F.col("url")) | is_homepage(F.col("url")) | is_self_reference(F.col("source"), F.col("project")) | (count("taboo_words", WORD_IN_TITLE) > 0)
    city = F.transform("_city_names", lambda w: F.when(has(w, WORD_IN_TITLE), CITY).when((w == "") | has(w, IN_TITLE), CITY_PART))
    city = F.coalesce(F.try_element_at(F.filter(city, lambda x: x.isNotNull()), F.lit(1)), F.lit(0))
    low = F.lower(F.coalesce("source", F.lit("")))
    known = F.exists("_good_sources", lambda g: (low == g) | F.endswith(low, F.concat(F.lit("."), g)))
    total = F.lit(BASE) + F.least(F.lit(WORDS_MOST), PER_WORD * count("positive_words", WORD)) + F.when(F.col("engines") > 1, ENGINES).otherwise(0) + F.when(F.octet_length(s) > LONG_BYTES, LONG).otherwise(0)
    total = total + city - RIVAL * count("rival_cities", WORD_IN_TITLE) + F.when(known, SOURCE).otherwise(0)
    value = F.when(F.col("_taboo_words").isNull(), None).when(F.coalesce(reject, F.lit(False)), 0).otherwise(total).cast("int")
    return j.withColumn("score", value).drop("_t", "_b", "_found", *[f"_{c}" for c in lists])


def listed(entries: DataFrame, status: str = "", least: int = 0, limit: int = 0) -> DataFrame:
    """Entries of a status (all for ""), with a score of at least `least`, by falling score, then id; the first `limit`."""
    out = entries.filter(F.col("score") >= least)
    out = (out.filter(F.col("status") == status) if status else out).orderBy(F.desc("score"), "news_id")
    return out.limit(limit) if limit else out


def added(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """The store with the batch's entries whose URL it lacks, the first of each URL. Store rows stay as they are."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy("url").orderBy(order))).filter("_rn = 1").drop("_rn", order)
    return store.unionByName(first.join(store.select("url").distinct(), "url", "left_anti"))


def purged(store: DataFrame, gone: Column) -> DataFrame:
    return store.filter(~F.coalesce(gone, F.lit(False)))


def updated(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and score of named entries: "" and -1 keep what is there. changes: news_id, new_status, new_score."""
    j = store.join(changes, "news_id", "left")
    status = F.when(F.coalesce("new_status", F.lit("")) != "", F.col("new_status")).otherwise(F.col("status"))
    number = F.when(F.coalesce("new_score", F.lit(-1)) >= 0, F.col("new_score")).otherwise(F.col("score"))
    return j.withColumns({"status": status, "score": number}).drop("new_status", "new_score")


def folded(store: DataFrame | None, actions: DataFrame) -> DataFrame:
    """url, the entry after all actions (null for none) and `had`, whether the store had the URL, for each URL that actions name.

    actions: url, seq, action (add, update, purge) and the columns of an entry. In order of seq, an add of a URL that is there
    changes nothing, an update takes a status but "" and a score but -1, a purge takes the entry away. So of each URL the last
    purge counts, the first add after it, and the last status and score after that: three aggregates that merge partial results,
    however many actions a URL has.
    """
    names = [c for c in actions.columns if c not in ("url", "seq", "action")]
    entry = F.struct(*names)
    purges = actions.groupBy("url").agg(F.max(F.when(F.col("action") == "purge", F.col("seq"))).alias("purged"))
    kind = actions.select(entry.alias("e")).schema["e"].dataType
    held = purges.withColumn("held", F.lit(None).cast(kind)) if store is None else purges.join(store.select("url", entry.cast(kind).alias("held")), "url", "left")
    alive = actions.join(held, "url").filter(F.col("purged").isNull() | (F.col("seq") > F.col("purged")))
    stays = F.col("purged").isNull() & F.col("held").isNotNull()
    adds = alive.filter((F.col("action") == "add") & ~stays).groupBy("url").agg(F.min_by(entry, "seq").alias("first"), F.min("seq").alias("from"))
    begun = held.join(adds, "url", "left").select("url", F.col("held").isNotNull().alias("had"), F.when(stays, F.col("held")).otherwise(F.col("first")).alias("entry"), "from", "purged")
    later = actions.filter("action = 'update'").join(begun.filter("entry is not null").select("url", "from", "purged"), "url").filter("seq > coalesce(from, seq - 1) and seq > coalesce(purged, seq - 1)")
    last = lambda c, good: F.max(F.when(good, F.struct("seq", c)))[c].alias(f"new_{c}")
    changes = later.groupBy("url").agg(last("status", F.coalesce("status", F.lit("")) != ""), last("score", F.coalesce("score", F.lit(-1)) >= 0))
    j = begun.join(changes, "url", "left")
    after = F.col("entry").withField("status", F.coalesce("new_status", "entry.status")).withField("score", F.coalesce("new_score", "entry.score"))
    return j.select("url", F.when(F.col("entry").isNotNull(), after).alias("entry"), "had")


def absent(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that name no entry: an error for a caller to see."""
    return changes.join(store.select("news_id"), "news_id", "left_anti")


def totals(store: DataFrame) -> DataFrame:
    """One row: entries and different URLs of the store."""
    return store.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("url").alias("urls"))
