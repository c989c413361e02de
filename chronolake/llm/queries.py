"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, jaccard, mixing, pii, quality_classifier, quality_rules, repeats, warc
from .common import table


#: Stands in for a key from the caller's key store.
PSEUDONYM_KEY = b"example key of the registered query"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", "n_found", *(F.coalesce(F.col("kinds")[k], F.lit(0).cast("long")).alias(f"n_{k}") for k in pii.KINDS))


#: Both texts of the extra conversation.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    i = F.col("id")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), i.alias("turn"), F.when(i == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.format_trees(chat.turn_nodes(turns.unionByName(own))))


def _escaped(x: str) -> str:
    for raw, written in chat.ESCAPES:
        x = f"replace({x}, '{raw}', '{written}')"
    return x


OP2_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}'),
g as (select conv_id, count(*) n_turns,
             string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) turns,
             coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') loss,
             {len(chat.BEGIN)} + sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) chars
      from t group by conv_id)
select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, chars::bigint formatted_chars from g
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url_key", "time")


OP4_SQL = r"""
with u as (select page_id, encode(coalesce(html, '')) b, coalesce(url, '') url, substr(url, case when contains(url, '://') then instr(url, '://') + 3 else 1 end) rest from pages),
t as (select *, split_part(rest, '/', 1) host from u),
n as (select *, regexp_replace(split_part(regexp_replace(lower(host), '^.*@', ''), ':', 1), '^www\.', '') name from t),
k as (select page_id, b, case when url = '' then '' else array_to_string(list_reverse(string_split(name, '.')), ',') || ')' || split_part(substr(rest, length(host) + 1), '#', 1) end url_key from n),
p as (select page_id, b, row_number() over (order by url_key, page_id) - 1 position from k),
h as (select page_id, position, octet_length(b) n, sha1(b) h from p),
m as (select *, min(page_id) over (partition by h) first_id from h),
g as (select distinct h from h),
bits as (select h, array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i::int + 1, 1)) - 1), 4, '0')), '') b from g),
b32 as (select h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + 16 * substr(b, i::int * 5 + 1, 1)::int + 8 * substr(b, i::int * 5 + 2, 1)::int + 4 * substr(b, i::int * 5 + 3, 1)::int
              + 2 * substr(b, i::int * 5 + 4, 1)::int + substr(b, i::int * 5 + 5, 1)::int, 1)), '') d from bits)
select page_id, n::bigint payload_bytes, d payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to, position
from m join b32 using (h)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), length=100))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.PRODUCTION)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


OP9_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) h from documents)
select doc_id, max(doc_id) over (partition by h) keep_id, count(*) over (partition by h) group_size,
       doc_id = max(doc_id) over (partition by h) kept, h text_sha256
from d
"""

QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc_archives": op4_warc_archives,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_poisson_mixing": op7_poisson_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {
    "op4_warc_archives": OP4_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op7_poisson_mixing": mixing.sql(mixing.PRODUCTION),
    "op9_exact_dedup": OP9_SQL,
}
