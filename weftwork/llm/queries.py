"""The queries of the training-data operators, op<N>_<name>, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import decontamination, fingerprints, langid, licenses, mixing, negatives, oddsketch, prefixtrie, quality, sharding, simhash, tokencounts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by their nearest examples of `labels.toxic`."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; sources by code point weigh 5, 2, 1, repeating, and share 150% of all words."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints all documents and holds each against its edited text and the next document."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds the items of `benchmark` in all documents, a row for each pair."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash over 4-word shingles of whole documents; fingerprints link at 4 or fewer differing bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of all documents by cross-parsing against labelled text."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds or inherits a license for all documents, laid out as a tree of files, and all pages, by their addresses."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by trees learned from `labels.quality`."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version, kept by signed batches."""
    return tokencounts.roll_up(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals all documents into 16 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, searched in all rows of `embeddings`."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all prefixes of all rebuilt `conversations`, a row a node."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: five-word shingles, Jaccard similarity 0.85 or more."""
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_fingerprints, op4_decontamination, op5_simhash, op6_langid, op7_licenses, op8_quality, op9_token_counts, op10_sharding, op11_hard_negatives, op12_prefix_trie, op13_odd_sketches)}

SQL = {
    "op2_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         substr(md5('mix:' || coalesce(doc_id::varchar, coalesce(text, ''))), 1, 9) as key from documents),
bysrc as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [5, 2, 1][1 + ((row_number() over (order by source asc nulls last) - 1) % 3)::int] as weight,
         1.5 * (select sum(source_size) from bysrc) as budget from bysrc),
-- The common level: the caps of the sources under it, and the level times the weights of the others, make the budget.
lev as (
  select w.source, 2.0 * w.source_size / w.weight as level, w.weight, w.budget,
         coalesce((select sum(2 * v.source_size) from weighed v where 2.0 * v.source_size / v.weight < 2.0 * w.source_size / w.weight), 0) as held,
         (select sum(v.weight) from weighed v where 2.0 * v.source_size / v.weight >= 2.0 * w.source_size / w.weight) as rest from weighed w),
fill as (select (budget - held)::double / rest as lift, level from lev where budget - held < level * rest order by level limit 1),
goal as (
  select source, source_size,
         case when 2.0 * source_size / weight >= coalesce((select level from fill), 'infinity'::double)
              then least((select lift from fill) * weight, 2.0 * source_size) else 2.0 * source_size end::double as target from weighed),
edge as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from goal),
mass as (select source, key, sum(size) as mass from sized where size > 0 group by source, key),
cum as (select source, key, mass, sum(mass) over (partition by source order by key) as upto from mass),
cut as (
  select e.source, min(c.key) as below from edge e join cum c on c.source is not distinct from e.source
  where c.upto - c.mass / 2.0 > e.target - e.whole * e.source_size group by e.source)
select s.doc_id, s.size, e.source_size, e.target,
       (s.size * (e.whole + case when s.key < coalesce(c.below, 'g') then 1 else 0 end))::bigint as taken
from sized s join edge e on s.source is not distinct from e.source left join cut c on c.source is not distinct from s.source
""",
    "op11_hard_negatives": """
with v as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.uid, a.vec_id as anchor_id, b.vec_id as id, b.label = a.label as same, list_dot_product(a.v, b.v)::bigint as score
  from v a join v b on a.uid <> b.uid where a.vec_id % 50 = 0),
p as (
  select uid, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by uid order by score desc, id) as place
  from s where same),
n as (
  select p.uid, p.anchor_id, p.place, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score,
         row_number() over (partition by p.uid, p.place order by s.score desc, s.id) as rank
  from p join s on s.uid = p.uid
  where p.place <= 5 and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op12_prefix_trie": r"""
with table_ as (
  select list(list_reduce(list_prepend(n, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by n) as entries
  from (select unnest(range(256)) as n)),
t as (
  select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, d) - 1 as place, d, chars from t),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, entries[xor(a & 255, b) + 1])), 4294967295) % 6 as h
  from (select distinct conv_id from own), table_),
seq as (
  select c.conv_id, 0 as part, o.place, o.d, o.chars from c join own o on o.conv_id = c.base where o.place < c.h
  union all select c.conv_id, 1, o.place, o.d, o.chars from c join own o on o.conv_id = c.conv_id where o.place >= c.h),
deep as (select conv_id, d, chars, row_number() over (partition by conv_id order by part, place) as depth from seq),
keyed as (select conv_id, depth, chars, string_agg(d, '') over (partition by conv_id order by depth rows unbounded preceding) as key from deep),
paths as (
  select conv_id, depth, chars, key, left(key, length(key) - 64) as parent from keyed
  union all select conv_id, 0, 0, '', null from c),
ends as (select conv_id, max(depth) as depth from paths group by conv_id),
ended as (
  select p.depth, p.key, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as ends
  from paths p join ends e on e.conv_id = p.conv_id and e.depth = p.depth group by p.depth, p.key),
nodes as (select depth, key, min(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars from paths group by depth, key),
kids as (select depth - 1 as depth, parent as key, count(*) as n from nodes where depth > 0 group by 1, 2),
valued as (select n.*, coalesce(k.n, 0) as n_children, (k.n is null)::int as leaf, (n.n_convs - 1) * n.chars as saved from nodes n left join kids k on k.depth = n.depth and k.key = n.key),
sums as (
  select p.depth, p.key, sum(v.leaf) as n_leaves, sum(v.saved) as saved_tokens
  from valued v join paths p on p.conv_id = v.conv_id and p.depth <= v.depth group by p.depth, p.key)
select v.conv_id, v.depth::bigint as depth, u.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens,
       coalesce(e.ends, sha256('')) as ends_sha256
from valued v join sums s on s.depth = v.depth and s.key = v.key
left join nodes u on u.depth = v.depth - 1 and u.key = v.parent left join ended e on e.depth = v.depth and e.key = v.key
""",
    "op13_odd_sketches": r"""
with recursive w as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as materialized (
  select rid, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
sh as materialized (select rid, len(s) as n, unnest(s) as x from sets),
links as materialized (
  select a.rid as u, b.rid as v from sh a join sh b on a.x = b.x and a.rid <> b.rid
  group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select rid as u, rid as v from w union select r.u, l.v from reach r join links l on l.u = r.v),
least as (select r.u as rid, min(w.doc_id) as component_id from reach r join w on w.rid = r.v group by r.u)
select s.doc_id, len(s.s)::bigint as n_shingles, l.component_id, s.doc_id is not distinct from l.component_id as kept
from sets s join least l on l.rid = s.rid
""",
}
