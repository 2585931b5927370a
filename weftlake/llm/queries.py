"""Registered queries of the training-data operators, and their SQL where SQL can
express them. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.decontam import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.suffix import repeats

    found = repeats(read_table(spark, sf_dir, "documents"))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["first_word"].cast("string"), s["last_word"].cast("string"))), " ")
    return found.select("doc_id", "n_repeated", "n_later", as_text("spans").alias("spans"), as_text("later").alias("later"))


#: Words in windows of 50 that occur again; the later ones in the order of doc_id and place.
OP3_SQL = """
with d as (select distinct doc_id, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, text, w, unnest(range(0, greatest(len(w) - 49, 0))) as i from d),
h as (select doc_id, text, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as h from s),
n as (select doc_id, text, i, count(*) over (partition by h) as n, row_number() over (partition by h order by doc_id, i) as rn from h),
p as (select doc_id, 'spans' as k, i from n where n > 1 union all select doc_id, 'later', i from n where n > 1 and rn > 1),
g as (select doc_id, k, i, sum(case when i <= prev + 50 then 0 else 1 end) over (partition by doc_id, k order by i) as run
  from (select *, lag(i) over (partition by doc_id, k order by i) as prev from p)),
r as (select doc_id, k, min(i) as a, max(i) + 49 as b from g group by doc_id, k, run)
select doc_id, sum(case when k = 'spans' then b - a + 1 else 0 end)::bigint as n_repeated, sum(case when k = 'later' then b - a + 1 else 0 end)::bigint as n_later,
  coalesce(string_agg(a || '-' || b, ' ' order by a) filter (where k = 'spans'), '') as spans, coalesce(string_agg(a || '-' || b, ' ' order by a) filter (where k = 'later'), '') as later
from r group by doc_id"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.simhash import as_hex, near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(found["fp"]).alias("fingerprint"), "component_id")


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.cws import fingerprint_pairs

    return fingerprint_pairs(read_table(spark, sf_dir, "documents"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.compact import near_passages

    return near_passages(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.sharding import shard

    return shard(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.tokencount import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.filters import audit

    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: Masks of failed filters for each document, counted for each part, summed up for each order.
OP11_SQL = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d),
f as (select doc_id, part, (case when len(words) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end)
    + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end) as m from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, m, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by part, m),
s as (select x.l as a, y.l as b, z.l as c, v.l as d, u.l as e, x.l || y.l || z.l || v.l || u.l as filter_order
  from (values ('A'), ('B'), ('C'), ('D'), ('E')) x(l), (values ('A'), ('B'), ('C'), ('D'), ('E')) y(l), (values ('A'), ('B'), ('C'), ('D'), ('E')) z(l),
    (values ('A'), ('B'), ('C'), ('D'), ('E')) v(l), (values ('A'), ('B'), ('C'), ('D'), ('E')) u(l)
  where x.l <> y.l and z.l not in (x.l, y.l) and v.l not in (x.l, y.l, z.l) and u.l not in (x.l, y.l, z.l, v.l)),
o as (select filter_order, step, (1 << (ascii(filter_order[step]) - 65)) as own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int as prior from s, (select unnest(range(1, 6)) as step))
select part, filter_order, step::int as step,
  coalesce(sum(n) filter (where m & (own | prior) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (where m & own <> 0 and m & prior = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where m & own <> 0 and m & prior <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (where m = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where m & own <> 0 and m & prior = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where m & own <> 0 and m & prior = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(m::int), 1)) filter (where m & own <> 0), 0)::bigint as shapley
from c, o group by part, filter_order, step"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.align import alignments

    return alignments(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlake.llm.repair import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_extraction": op2_extraction,
        "op3_suffix_repeats": op3_suffix_repeats,
        "op4_language_id": op4_language_id,
        "op5_simhash": op5_simhash,
        "op6_weighted_fingerprints": op6_weighted_fingerprints,
        "op7_compact_windows": op7_compact_windows,
        "op8_packing": op8_packing,
        "op9_sharding": op9_sharding,
        "op10_token_counts": op10_token_counts,
        "op11_filter_audit": op11_filter_audit,
        "op12_token_alignment": op12_token_alignment,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_repeats": OP3_SQL, "op11_filter_audit": OP11_SQL}
