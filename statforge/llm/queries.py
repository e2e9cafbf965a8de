"""The queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, licences, mixing, neardup, packing, pages, privacy, quality, search, tokens
from .tables import table
from .textops import WORD_PATTERN

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(table(spark, sf_dir, "pages"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = f"""
with dw as (
  select doc_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) as word from documents where text is not null
),
q as (
  select item_id, word, count(*) as qtf
  from (select item_id, unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) as word from benchmark) group by all
),
size as (select count(*) as n from documents where text is not null),
len as (select doc_id, count(*) as dl from dw group by doc_id),
mean as (select sum(dl) / any_value(n) as avgdl from len, size),
tf as (select doc_id, word, count(*) as tf from dw where word in (select word from q) group by all),
idf as (select word, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, size group by word),
score as (
  select item_id, doc_id,
    round(sum(qtf * idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) as score
  from q join tf using (word) join idf using (word) join len using (doc_id), mean
  group by item_id, doc_id
)
select item_id as query_id, doc_id, score, rank::integer as rank
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score) where rank <= 10
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumnsRenamed({"_copy": "copy", "_order": "shuffle_key"})


#: The default targets: sizes of the sources to the power of one half.
OP6_SQL = f"""
with size as (select source, sum(length(text)) as n from documents group by source),
rate as (select source, sqrt(n) / sum(sqrt(n)) over () * sum(n) over () / n as r from size),
span as (select source, r, greatest(0, floor(r) - ceil(12 * sqrt(r)))::bigint as low, (floor(r) + ceil(12 * sqrt(r)) + 40)::bigint as high from rate),
term as (select source, low, k, exp(-r + k * ln(r) - lgamma(k + 1)) as p from span, lateral (select unnest(range(low, high + 1)) as k)),
cdf as (select source, low, k, sum(p) over (partition by source order by k) as c from term),
doc as (
  select *, md5('{mixing.SEED}|' || doc_id || '|' || md5(text)) as own, (('0x' || substr(own, 1, 13))::bigint::double + 0.5) / {float(16**13)} as u from documents
),
n as (
  select d.doc_id, any_value(c.low) + count(*) filter (where c.c < d.u) as n
  from doc d join cdf c on d.source = c.source group by d.doc_id
)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, g.copy::bigint as copy,
  (('0x' || substr(md5(g.copy || '|' || d.own), 1, 13))::bigint::double + 0.5) / {float(16**13)} as shuffle_key
from doc d join n on d.doc_id = n.doc_id, generate_series(1, n.n) g(copy)
"""


def op7_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.recordings_aligned(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", decode=audio.rendered)


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymised(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_finds(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    """Every file word against every template word, grouped by relative position."""
    rows, sizes = [], []
    for t, template in enumerate(licences.TEMPLATES):
        compiled = licences.Compiled((template,), licences.COVERAGE)
        words = re.findall(WORD_PATTERN, template.text.lower())
        rows += [f"({t}, {p}, '{w}', {int(compiled.key[0][p])})" for p, w in enumerate(words)]
        sizes.append(f"({t}, '{template.licence}', {len(words)}, {compiled.need[0]}, {int(compiled.key[0].sum())})")
    return f"""
with template(template, pos, word, key) as (values {", ".join(rows)}),
size(template, licence, n, need, keys) as (values {", ".join(sizes)}),
list as (select doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') as words from documents where text is not null),
file as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from list),
hit as (
  select doc_id, template, file.pos - template.pos as word_pos, count(*) as n, sum(key) as keys
  from file join template using (word) group by all
)
select doc_id, licence, template::integer as template, word_pos::integer as word_pos, round(hit.n / size.n, 6) as coverage
from hit join size using (template) where hit.n >= need and hit.keys = size.keys
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_html_text": op2_html_text,
        "op3_topk_search": op3_topk_search,
        "op4_packing": op4_packing,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_poisson_mixing": op6_poisson_mixing,
        "op7_chroma_alignment": op7_chroma_alignment,
        "op8_quality_ranking": op8_quality_ranking,
        "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
        "op10_licence_scan": op10_licence_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3_SQL, "op6_poisson_mixing": OP6_SQL, "op10_licence_scan": _op10_sql()}
