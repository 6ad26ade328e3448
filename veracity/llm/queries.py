"""One production query per operator of this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.decontamination import find_leaks
from veracity.llm.hard_negatives import mine_hard_negatives
from veracity.llm.html_wrappers import extract_main_text
from veracity.llm.jaccard_join import near_duplicates
from veracity.llm.language import identify_languages
from veracity.llm.line_dedup import dedup_lines
from veracity.llm.lm_scoring import score_texts
from veracity.llm.packing import pack_documents
from veracity.llm.phrases import mine_collocations
from veracity.llm.quality_rules import assess
from veracity.llm.sharding import shard_rows
from veracity.llm.token_counts import count_tokens
from veracity.llm.toxicity import score_toxicity
from veracity.sources.tables import read_table


def default_vocabulary() -> str:
    """Path of the public tokenizer file the token-count query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_tokens=1)
    d = F.col("line_dedup")
    return cleaned.select("doc_id", d["n_lines"].alias("n_lines"), d["n_dropped_lines"].alias("n_dropped_lines"),
                          d["dropped"].alias("dropped_lines"), d["clean_text"].alias("clean_text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = assess(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    q = F.col("quality")
    return judged.select("doc_id", *(q[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_kept_words", "n_failed_lines")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), default_vocabulary())


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read_table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return mine_hard_negatives(vectors.withColumn("label", F.expr(
        "case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_decontamination, op3_ngram_jaccard_join, op4_sharding,
                            op5_line_dedup, op6_best_fit_packing, op7_toxicity, op8_language_id, op9_quality_rules,
                            op10_token_counts, op11_phrase_collocations, op12_html_extraction,
                            op13_hard_negatives)
}

# DuckDB twins of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op9_quality_rules": r"""
with t as (
  select row_number() over () as rn, doc_id, coalesce(text, '') as text from documents
), l as (
  select rn, text, string_split(text, chr(10)) as all_lines,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t
), x as (
  select rn, w, text, unnest(all_lines) as line, generate_subscripts(all_lines, 1) as pos from l
), f as (
  select rn, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as lw,
         length(line) as chars,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as syms,
         length(line) - length(regexp_replace(line, '[!?]', '', 'g')) as marks,
         length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) as bars,
         right(rtrim(line, ' '), 1) as tail
  from x
), v as (
  select rn, line, lw,
         lw > 0 and (syms * 10 > chars or (marks * 10 > chars and lw > 1)
           or (tail not in ('.', '!', '?', ':', ';', '…', '"', '''', '”', '’', '»', ')', ']', '。', '！', '？') and lw < 4)
           or (bars >= 3 and bars * 4 >= lw)
           or (chars <= 160 and regexp_matches(line, '[Aa]ll rights reserved|[Cc]ookie policy|[Pp]rivacy policy|[Tt]erms of (use|service)|[Ee]nable [Jj]ava[Ss]cript|[Ll]orem ipsum|[Cc]lick here|[Rr]ead more|[Ss]ign up|[Ll]og in|[Ss]ubscribe|([Ll]icensed|[Rr]eleased) under the'))) as bad
  from f
), s as (
  select rn, sum(lw) filter (where not bad) as good_words, count(*) filter (where bad) as lost,
         count(*) filter (where lw > 0) - count(distinct line) filter (where lw > 0) as dup
  from v group by rn
), g as (
  select rn, i, array_to_string(w[i:i+4], ' ') as win from (select rn, w, unnest(range(1, len(w) - 3)) as i from l)
), d as (
  select rn, i, count(*) over (partition by rn, win) as c from g
), p as (
  select rn, i, lead(i) over (partition by rn order by i) as nx from d where c > 1
), r as (
  select rn, sum(least(5, coalesce(nx - i, 5))) as repeat from p group by rn
), b as (
  select t.doc_id, len(l.w) as n, length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) as syms,
         s.dup, coalesce(r.repeat, 0) as repeat, coalesce(s.good_words, 0) as good_words, s.lost
  from t join l using (rn) join s using (rn) left join r using (rn)
)
select doc_id, cast(n as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(syms as bigint) as n_symbols,
       cast(dup as bigint) as n_dup_lines, cast(repeat as bigint) as n_repeat_words,
       n < 10 or 100 * repeat > 20 * n as base_failed,
       not (n < 10 or 100 * repeat > 20 * n) and good_words >= n * 0.5 as kept,
       cast(good_words as bigint) as n_kept_words, cast(lost as bigint) as n_failed_lines
from b
""",
    "op11_phrase_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), starts as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0
), grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) as k from starts)
), f as (
  select lang, phrase, k, count(*) as f from grams group by all having count(*) >= 30
), n as (
  select lang, count(*) as n from starts group by lang
), c as (
  select lang, phrase, k, f as a, string_split(phrase, ' ') as w from f where k > 1
), cuts as (
  select lang, phrase, a, k, w, unnest(range(1, k)) as cut from c
), scored as (
  select x.lang, x.phrase, x.a, x.cut, p.f as l, q.f as r, (2000000 * x.a::hugeint) // (p.f + q.f) as score
  from cuts x
  join f p on p.lang = x.lang and p.phrase = array_to_string(x.w[1:x.cut], ' ')
  join f q on q.lang = x.lang and q.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_ as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, w, k, a, m, unnest(range(1, k - m + 2)) as i
        from (select lang, w, k, a, unnest(range(2, k)) as m from c where k > 2))
  group by 1, 2
), ranked as (
  select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank
  from best b left join inner_ i using (lang, phrase)
  where i.longer is null or 100 * i.longer::hugeint < 80 * b.a::hugeint
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
       score::bigint as score, cut::bigint as first_words
from ranked join n using (lang) where rank <= 2000
""",
    "op13_hard_negatives": """
with v as (
  select vec_id, label, q
  from (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
               list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings)
  where label is not null and q is not null
    and list_sum(list_transform(q, lambda x: case when x is null or not isfinite(x) then 1 else 0 end)) = 0
), a as (
  select * from v where vec_id % 100 = 0
), s as (
  select a.vec_id as anchor_id, a.label as anchor_label, v.vec_id, v.label,
         cast(list_inner_product(a.q, v.q) as bigint) as score
  from a cross join v where a.vec_id <> v.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), x as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from x where rank <= 10
""",
}
