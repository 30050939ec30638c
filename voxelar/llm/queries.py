"""Queries over the given tables that apply each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, hard_negatives, html_extract, mixing, packing, phrases, quality, sharding, simhash, substring_dedup, token_output, warc
from ._common import read


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(
        "doc_id", "source", "slot", "shard"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialised_order(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_substring_dedup,
        op3_html_text,
        op4_quality,
        op5_sharding,
        op6_mixing,
        op7_training_order,
        op8_exact_dedup,
        op9_warc,
        op10_simhash,
        op11_hard_negatives,
        op12_packing,
        op13_phrases,
    )
} | {"pipeline": _pipeline}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
win as (
  select doc_id, p, list_slice(ws, p, p + 19) as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from w where len(ws) >= 20)
),
dup as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as r from win) where r > 1),
gone as (select distinct doc_id, p + i as q from dup, range(20) t(i)),
marks as (select doc_id, list(q) as qs from gone group by doc_id),
kept as (
  select w.doc_id, len(ws) as n, coalesce(len(qs), 0) as removed,
    case when qs is null then ws
      else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(qs, x[2])), lambda x: x[1]) end as ks
  from w left join marks using (doc_id)
)
select doc_id, n as n_words, removed as n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) as kept_sha256 from kept
"""

_COMMON = "map {" + ", ".join(f"'{k}': string_split('{v}', ' ')" for k, v in quality.COMMON_WORDS.items()) + "}"
_R = quality.Rules()


def _js(p: str, q: str) -> str:
    part = "case when {0} > 0 then {0} * log2(2 * {0} / ({0} + {1})) else 0 end"
    terms = f"lambda z: {part.format('z[1]', 'z[2]')} + {part.format('z[2]', 'z[1]')}"
    return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), {terms})) / 2))"


_OP4 = f"""
with w as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {_WORDS} as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents
),
g as (
  select doc_id, p, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from w where len(ws) >= 3)
),
rep as (select doc_id, p from (select *, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
cov as (select doc_id, count(distinct p + i) as n from rep, range(3) t(i) group by doc_id),
base as (
  select w.doc_id, lang, len(ws) as n_words, length(text) as chars, length(array_to_string(ws, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[a-zß-öø-ÿ]', '', 'g')) as lower_,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
    list_transform(({_COMMON})[lang], lambda c: len(list_filter(ws, lambda x: x = c))) as hits
  from w left join cov using (doc_id)
),
sums as (
  select lang, sum(n_words) as n_words, sum(chars) as chars, sum(word_chars) as word_chars, sum(n_symbols) as n_symbols,
    sum(lower_) as lower_ from base group by lang having sum(n_words) >= {_R.reference_words}
),
hit as (
  select lang, list(n order by i) as hits from (
    select lang, i, sum(hits[i]) as n from base, range(1, 30) t(i) where i <= len(hits) group by lang, i
  ) group by lang
),
cls as (
  select 'doc' as kind, doc_id, lang, n_words, chars, word_chars, n_symbols, lower_, hits from base
  union all
  select 'ref', null, sums.lang, n_words, chars, word_chars, n_symbols, lower_, hit.hits from sums left join hit on sums.lang = hit.lang
),
shares as (
  select *, [lower_ / chars, (chars - word_chars) / chars, n_symbols / chars, (word_chars - lower_ - n_symbols) / chars] as c,
    list_concat(list_transform(hits, lambda n: n / n_words), [1.0::double - coalesce(list_sum(list_transform(hits, lambda n: n / n_words)), 0)]) as h
  from cls
),
dist as (
  select d.doc_id,
    case when d.chars >= {_R.guard_chars} then {_js("d.c", "r.c")} end as cd,
    case when d.n_words >= {_R.guard_words} and d.hits is not null then {_js("d.h", "r.h")} end as wd
  from shares d left join shares r on r.kind = 'ref' and r.lang = d.lang where d.kind = 'doc'
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {_R.min_words} or 100 * n_repeat_words > {_R.max_repeat_percent} * n_words as base_failed,
  not (n_words < {_R.min_words} or 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
    and coalesce(cd, 0) <= {_R.max_char_distance} and coalesce(wd, 0) <= {_R.max_word_distance} as kept
from base join dist using (doc_id)
"""


def _op5() -> str:
    table = "[" + ",".join(map(str, sharding.fill(list(range(sharding.SHARDS))))) + "]"
    return f"""
with s as (
  select doc_id, source, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})::integer as slot
  from documents
)
select doc_id, source, slot, ({table}[slot + 1])::integer as shard from s
"""


#: The SQL looks at the marginals this often; more blocks of rounds are not needed on the given tables.
_OP6_BLOCKS = 3


def _op6() -> str:
    dims, keep = mixing.DIMENSIONS, mixing.KEEP
    parts = []
    upto = "(order by cap / nullif(pull, 0) desc nulls first, {} rows between unbounded preceding and current row)"
    for d in dims:
        parts.append(
            f"""a_{d} as materialized (select *, pow(has, {mixing.POWER}) / sum(pow(has, {mixing.POWER})) over () as pull, {mixing.CEILING} * has as cap,
  {keep} * sum(has) over () as wanted from (select {d}, sum(tokens)::double as has from cells group by {d})),
g_{d} as materialized (select {d}, least(cap, pull * greatest(0, max(scale) over ())) as to_{d}
  from (select *, (wanted - (sum(cap) over () - sum(cap) over {upto.format(d)})) / nullif(sum(pull) over {upto.format(d)}, 0) as scale from a_{d}))"""
        )
    joins = " ".join(f"join g_{d} using ({d})" for d in dims)
    parts.append(f"r0 as materialized (select cells.*, tokens::double as cap, tokens::double as pull, {', '.join(f'to_{d}' for d in dims)} from cells {joins})")
    last, found = "r0", []
    for i in range(1, _OP6_BLOCKS * mixing.ROUNDS + 1):
        for d in dims:
            now = f"r{i}_{d}"
            parts.append(
                f"""{now} as materialized (select * exclude (pull, capped, free, pulled),
  pull * coalesce(case when free > 0 and to_{d} - capped > 0 then (to_{d} - capped) / free else to_{d} / nullif(pulled, 0) end, 0) as pull
  from (select *, sum(case when pull >= cap then cap else 0 end) over (partition by {d}) as capped, sum(pull) over (partition by {d}) as pulled,
    sum(case when pull >= cap then 0 else pull end) over (partition by {d}) as free from {last}))"""
            )
            last = now
        if i % mixing.ROUNDS == 0:
            off = " union all ".join(f"select sum(least(pull, cap)) as kept, any_value(to_{d}) as goal from {last} group by {d}" for d in dims)
            met = f"(select max(abs(kept - goal)) / (sum(goal) / 3) <= {mixing.TOLERANCE} from ({off}))"
            rest = " and ".join(f"not b{n}.met" for n in range(len(found)))
            parts.append(f"b{len(found)} as materialized (select {met if i < _OP6_BLOCKS * mixing.ROUNDS else 'true'} as met)")
            others = ", ".join(f"b{n}" for n in range(len(found) + 1))
            found.append(f"select source, lang, topic, tokens, least(pull, cap) as kept from {last}, {others} where b{len(found)}.met" + (f" and {rest}" if rest else ""))
    chain = ",\n".join(parts)
    return f"""
with counts as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, len({_WORDS}) as tokens from documents
),
docs as (
  select *, case when tokens < 100 then 'note' when tokens < 1000 then 'article' else 'longform' end as topic from counts
),
cells as materialized (select source, lang, topic, sum(tokens)::bigint as tokens from docs group by all),
{chain},
fitted as ({" union all ".join(found)}),
p as (
  select source, lang, topic, round(kept / sum(kept) over (), {mixing.DIGITS}) as weight,
    round(case when tokens > 0 then kept / tokens else 1.0 end, {mixing.DIGITS}) as probability
  from fitted
)
select doc_id, docs.source, docs.lang, docs.topic, docs.tokens, weight, probability,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / pow(2.0, 52) < probability as selected
from docs join p using (source, lang, topic)
"""


_OP8 = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""

_OP9 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first then first end as refers_to
from f
"""

_OP11 = f"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from r a join r on len(a.v) = len(r.v) and (a.vec_id <> r.vec_id or a.label <> r.label) where a.vec_id % 100 = 0
),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {hard_negatives.POSITIVES}
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join pairs using (anchor_id)
where not same and 100 * score between {hard_negatives.LOW} * positive_score and {hard_negatives.HIGH} * positive_score
qualify rank <= {hard_negatives.NEGATIVES}
"""

_OP13 = f"""
with pieces as (
  select lang, row_number() over () as p, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
  )
),
grams as (
  select lang, k, array_to_string(ws[i : i + k - 1], ' ') as g
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from pieces, range(1, 4) t(k) where len(ws) >= k)
),
f as materialized (select lang, k, g, count(*) as a from grams group by all),
c as materialized (select *, string_split(g, ' ') as ws from f where k > 1 and a >= {phrases.LEAST}),
parts as (
  select lang, k, g, a, cut, array_to_string(ws[1 : cut], ' ') as x, array_to_string(ws[cut + 1 : k], ' ') as y
  from (select *, unnest(range(1, k)) as cut from c)
),
cuts as (
  select p.lang, p.k, p.g, p.a, cut, l.a as l, r.a as r, (1000000::hugeint * p.a * p.a) // (l.a::hugeint * r.a) as score
  from parts p join f l on l.lang = p.lang and l.g = p.x join f r on r.lang = p.lang and r.g = p.y
),
weakest as (select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1),
longer as (
  select lang, g, max(a) as a from (select lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as g, a from c where k = 3) group by all
),
kept as (
  select w.lang, g as phrase, w.a, w.l, w.r, w.score::bigint as score
  from weakest w left join longer using (lang, g) where coalesce(100 * longer.a < {phrases.COVERED} * w.a, true)
),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join n using (lang) qualify rank <= {phrases.TOP}
"""

ORACLES = {
    "op2_substring_dedup": _OP2,
    "op4_quality": _OP4,
    "op5_sharding": _op5(),
    "op6_mixing": _op6(),
    "op8_exact_dedup": _OP8,
    "op9_warc": _OP9,
    "op11_hard_negatives": _OP11,
    "op13_phrases": _OP13,
}
