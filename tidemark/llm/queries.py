"""The named queries of this subpackage over the supplied tables, and SQL texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contamination
from tidemark.llm.frames import read_table, settled
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.html_extraction import main_texts
from tidemark.llm.language_id import languages
from tidemark.llm.lm_scoring import scored_texts
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import packed
from tidemark.llm.prefix_trie import conversation_paths, prefix_trie, with_shared_heads
from tidemark.llm.quality_classifier import quality_scores
from tidemark.llm.quality_rules import cleaned
from tidemark.llm.source_mixing import mixed
from tidemark.llm.suffix_dedup import without_repeats
from tidemark.llm.token_counts import masked_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("op6_minhash_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"))


SQL["op6_minhash_dedup"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.s = b.s and a.doc_id != b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach as (
  select doc_id as id, doc_id as r from documents
  union select l.b, reach.r from reach join links l on l.a = reach.id
)
select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(reach.r) as component_id, d.doc_id = min(reach.r) as kept
from documents d left join sizes s on s.doc_id = d.doc_id join reach on reach.id = d.doc_id group by d.doc_id
"""


@query("op10_suffix_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(read_table(spark, folder, "documents")).drop("kept")


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")).drop("items")


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return languages(read_table(spark, folder, "documents"))


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read_table(spark, folder, "documents"))


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(read_table(spark, folder, "pages"))


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned(read_table(spark, folder, "documents"), with_text=False)


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return masked_counts(read_table(spark, folder, "documents"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return scored_texts(read_table(spark, folder, "documents"))


SQL["op7_decontamination"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as s
  from (select item_id, w, least(len(w), 13) as m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from bw where len(w) > 0)
), places as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as s
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from dw join (select distinct m from win) z on len(w) >= m)
), hits as (select p.doc_id, p.i, p.m, b.item_id from places p join win b on p.s = b.s and p.m = b.m
), hit_words as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + m)) as x from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as listed
  from (select distinct doc_id, item_id::varchar as k from hits) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  sha256(coalesce(t.listed, '')) as items_sha256, coalesce(h.n_hit > 0 and 20 * h.n_hit >= len(d.w), false) as contaminated
from dw d left join hit_words h on h.doc_id = d.doc_id left join items t on t.doc_id = d.doc_id
"""


@query("op11_hard_negatives")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, folder, "embeddings").withColumn("label", label), "vec_id % 50 = 0")


SQL["op11_hard_negatives"] = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.e, r.e)::bigint as score
  from v a join v r on a.vec_id != r.vec_id and len(a.e) = len(r.e) where a.vec_id % 50 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
where 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify rank <= 3
"""


@query("op12_prefix_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    paths = settled(conversation_paths(read_table(spark, folder, "conversations")))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie(with_shared_heads(paths, F.col("conv_id") - F.col("conv_id") % 20, head))


SQL["op12_prefix_trie"] = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} as x
  from conversations where conv_id is not null
), own as (select conv_id, list(x order by k) as xs from turns group by conv_id),
headed as (
  select conv_id, xs, conv_id - conv_id % 20 as base, xor(4294967295, list_reduce(
    [4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 4 as h
  from own
), paths as (
  select a.conv_id, list_concat(coalesce(b.xs[1 : a.h], []), a.xs[a.h + 1 :]) as p from headed a left join own b on b.conv_id = a.base
), prefixes as (select conv_id, len(p) as total, d, p[1 : d] as node from (select conv_id, p, unnest(range(0, len(p) + 1)) as d from paths)
), nodes as (
  select node, d, min(conv_id) as id, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (where total = d) as ends,
    case when d > 0 then len(regexp_extract_all(node[d].text, '[^ 	-
]+')) else 0 end as words
  from prefixes group by node, d
), children as (select node[1 : d - 1] as node, count(*) as c from nodes where d > 0 group by 1),
facts as (select n.*, coalesce(c.c, 0) as c from nodes n left join children c on c.node = n.node),
above as (select node[1 : e] as node, e, c, (n - 1) * words as saved from (select *, unnest(range(0, d + 1)) as e from facts)),
sums as (select node, sum((c = 0)::int)::bigint as leaves, sum(saved)::bigint as saved from above group by node)
select f.id as conv_id, f.d::bigint as depth, u.id as parent_conv_id, f.n::bigint as n_convs, f.c::bigint as n_children,
  s.leaves as n_leaves, s.saved as saved_tokens, sha256(coalesce(f.ends, '')) as ends_sha256
from facts f join sums s on s.node = f.node left join facts u on f.d > 0 and u.d = f.d - 1 and u.node = f.node[1 : f.d - 1]
"""


@query("op13_source_mixing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(read_table(spark, folder, "documents"))
