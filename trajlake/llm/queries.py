"""Registered queries of the text operators, each over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import (
    cascade,
    collocations,
    dartminhash,
    gam,
    hmm,
    imatch,
    impact,
    mixing,
    patterns,
    seekable,
    spelling,
    surrogates,
    treebpe,
)
from trajlake.llm.common import remainder, save, table
from trajlake.plans.registry import query

END_ID = 2


@query("op1_hidden_markov")
def op1_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.scored(table(spark, sf, "documents"))


@query("op2_seekable_frames")
def op2_seekable_frames(spark: SparkSession, sf: str) -> DataFrame:
    path = seekable.write(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    back = seekable.read(spark, path).select("shard", "place", "doc_id", "before", "n_tokens", "ids_crc32")
    return seekable.with_starts(save(back, "digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_imatch")
def op3_imatch(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf, "documents"))


OP4_SQL = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), urls as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), rules(rule_host, rule_path, action) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, action,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as n
  from urls left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from fits where n = 1
"""


@query("op4_bloom_cascade", OP4_SQL)
def op4_bloom_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.judged(table(spark, sf, "pages"), cascade.rule_table(spark))


@query("op5_additive_quality")
def op5_additive_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = gam.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    held = (remainder(3) == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
) where rank <= 5
"""


@query("op6_impact_index", OP6_SQL)
def op6_impact_index(spark: SparkSession, sf: str) -> DataFrame:
    return impact.top(impact.whole_numbers(table(spark, sf, "embeddings")), F.col("id") % 50 == 0)


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    replaced, _ = surrogates.replace(table(spark, sf, "documents"))
    return replaced.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_entities")


@query("op8_pattern_packing")
def op8_pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = patterns.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return packed.drop("ids")


@query("op9_block_mixing")
def op9_block_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed, _ = mixing.mixed(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_dart_minhash")
def op10_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return dartminhash.classed(table(spark, sf, "documents")).select("doc_id", "class_id")


OP11_SQL = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select doc_id, run, count(*) as c from (
    select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 5 group by all
), bytes as (
  select *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch:
    case when unicode(ch) < 128 then [unicode(ch)::bigint] else [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::bigint[] end)) as b from runs
), hashed as (
  select run, c, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) as h
  from bytes, crc_table
), words as (
  select word, sum(c)::bigint as n from (
    select c, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 5 group by word having sum(c) >= 3
), cuts as (
  select word, n, length(word) as len, i, left(word, i::int) || substr(word, i::int + 2) as rest from words, unnest(range(length(word))) as u(i)
), near as (
  select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.len = b.len and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from words a join cuts b on a.word = b.rest
  union select b.word, a.word, a.n from words a join cuts b on a.word = b.rest
), best as (
  select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by word
), formed as (
  select w.word, case when b.near_n >= 2 * w.n then b.near end as form, w.n, coalesce(b.n_near, 0)::bigint as n_near,
         case when b.near_n >= 2 * w.n then b.near_n end as form_n from words w left join best b using (word)
), up(word, last, depth) as (
  select word, word, 0 from formed
  union all select u.word, f.form, u.depth + 1 from up u join formed f on u.last = f.word where f.form is not null
), chain as (
  select word, first(last order by depth desc) as root from up group by word
)
select word, form, root, n, n_near, form_n from formed join chain using (word)
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


@query("op12_tree_bpe")
def op12_tree_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return treebpe.digests(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as w from (
    select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as piece from documents)
), placed as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), grams as (
  select lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, k, count(*) as f
  from placed, unnest([1, 2, 3, 4, 5]) as u(k) where i + k - 1 <= len(w) group by all
), totals as (
  select lang, sum(f)::hugeint as n from grams where k = 1 group by lang
), cand as (
  select lang, phrase, string_split(phrase, ' ') as w, k as size, f as a from grams where k >= 2 and f >= 100
), cuts as (
  select c.lang, c.phrase, c.a, c.size, j, l.f as l, r.f as r, n, (1000::hugeint * c.a * n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, size)) as j from cand) c
  join grams l on l.lang = c.lang and l.phrase = list_aggregate(c.w[1:c.j], 'string_agg', ' ')
  join grams r on r.lang = c.lang and r.phrase = list_aggregate(c.w[c.j + 1:], 'string_agg', ' ')
  join totals t on t.lang = c.lang
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), parts as (
  select lang, a as longer, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase
  from cand, unnest([2, 3, 4]) as u(k), unnest([1, 2, 3, 4]) as v(i) where k < size and i + k - 1 <= size
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from lowest o where not exists (select 1 from parts p where p.lang = o.lang and p.phrase = o.phrase and 100 * p.longer >= 100 * o.a)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mined(table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
