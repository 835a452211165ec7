"""Queries of the word functions: normalisation, match predicates, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import normalize as N
from .corpora import GROUPED, KANA_PARTS, KANA_SQL, TO_KATA, grouped_parts, kana, kana_parts, quoted, sql_map
from .registry import query, table

LONG_SQL = (
    "list_reduce(string_split({x}, ''), lambda a, c: CASE WHEN c = 'ー' AND strpos({k}, right(a, 1)) > 0 AND a <> '' THEN a || translate(right(a, 1), {k}, {v}) ELSE a || c END, '')"
).replace("{k}", quoted("".join(N.LENGTHENS))).replace("{v}", quoted("".join(N.LENGTHENS.values())))


def _rule(name: str, rule: N.Rule, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kana_parts(spark, sf_dir).select("p_partkey", rule(F.col("x")).alias("word"))

    query(f"SELECT p_partkey, {sql} AS word FROM {KANA_PARTS}", name)(run)


_rule("norm_space", N.no_space, "replace(x, '　', '')")
_rule("norm_kana_fold", N.to_hira, sql_map("x", N.KATA_TO_HIRA))
_rule("norm_kana_unfold", N.to_kata, sql_map("x", N.HIRA_TO_KATA))
_rule("norm_long_vowel", N.long_vowels, LONG_SQL.replace("{x}", "x"))
_rule("norm_long_vowel_drop", N.no_long_vowel, "replace(x, 'ー', '')")
_rule("norm_sokuon", N.sokuon, sql_map("x", N.SOKUON))
_rule("norm_youon", N.youon, sql_map("x", N.YOUON))
_rule("norm_small_vowel", N.small_vowels, sql_map("x", N.SMALL_VOWELS))
_rule("norm_dakuten", N.dakuten, sql_map("x", N.DAKUTEN))
_rule("norm_handakuten", N.handakuten, sql_map("x", N.HANDAKUTEN))
_rule("norm_reverse", F.reverse, "reverse(x)")


def _typed(key: Column, name: Column, brand: Column, kind: Column) -> Column:
    """What a person might type: blanks at the ends, symbols, half-width katakana, and characters that can't be looked up."""
    odd = F.when(key % 5 == 0, "☆").when(key % 5 == 1, "é").when(key % 5 == 2, "🙂").when(key % 5 == 3, "¥").otherwise("")
    return F.concat(F.lit(" \t"), name, F.lit("-"), brand, odd, F.lit('"`~ｶﾞｯﾊﾟｰ'), kind, F.lit("　 "))


TYPED = "(' ' || chr(9) || p_name || '-' || p_brand || CASE p_partkey % 5 WHEN 0 THEN '☆' WHEN 1 THEN 'é' WHEN 2 THEN '🙂' WHEN 3 THEN '¥' ELSE '' END || '\"`~ｶﾞｯﾊﾟｰ' || p_type || '　 ')"
WIDE_SQL = f"regexp_replace({sql_map(f'translate({TYPED}, chr(9), chr(32))', N.TO_WIDE)}, '^　+|　+$', '', 'g')"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 NOT IN (1, 2) AND length({WIDE_SQL}) BETWEEN 1 AND 127 THEN {WIDE_SQL} END AS word FROM part")
def norm_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", N.full_width(_typed(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type"))).alias("word"))


MIXED = f"(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {KANA_SQL} || '☆' WHEN 1 THEN {sql_map('p_name', N.ASCII_WIDE)} WHEN 2 THEN {KANA_SQL} || '本' ELSE {sql_map('p_brand', N.ASCII_WIDE)} || 'ー' END AS x FROM part)"


@query(
    f"""SELECT p_partkey, CASE WHEN regexp_matches(x, '{N.KANA}') AND NOT regexp_matches(x, '{N.ALPHA}') AND NOT rest THEN 'kana'
        WHEN regexp_matches(x, '{N.ALPHA}') AND NOT regexp_matches(x, '{N.KANA}') AND NOT rest THEN 'alphabet' ELSE 'other' END AS word_class
        FROM (SELECT *, x LIKE '%本%' AS rest FROM {MIXED})"""
)
def norm_word_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, n = kana(F.col("p_name")), F.col("p_partkey") % 4
    wide = N.mapped(N.ASCII_WIDE)
    x = F.when(n == 0, F.concat(k, F.lit("☆"))).when(n == 1, wide(F.col("p_name"))).when(n == 2, F.concat(k, F.lit("本"))).otherwise(F.concat(wide(F.col("p_brand")), F.lit("ー")))
    return p.select("p_partkey", N.word_class(x).alias("word_class"))


@query(
    f"""SELECT doc_id, line_no, {sql_map("x", N.UPPER_LATIN)} AS word FROM (
        SELECT doc_id, line_no, regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g') AS x FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))
        WHERE length(x) BETWEEN 1 AND 255 AND regexp_matches(x, '^[\\x{{00}}-\\x{{FF}}]*$')"""
)
def norm_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are Latin-1 words, upper-cased as Latin books do: ß and ÿ stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), N.latin(F.col("line")).alias("x"))
    return d.where("x IS NOT NULL").select("doc_id", "line_no", N.upper_latin(F.col("x")).alias("word"))


@query(f"SELECT p_partkey, {sql_map(sql_map('p_name', N.ASCII_WIDE), N.UPPER_WIDE)} AS word FROM part")
def norm_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", N.upper_wide(N.mapped(N.ASCII_WIDE)(F.col("p_name"))).alias("word"))


@query(f"SELECT p_partkey, translate(replace(x, 'ー', '・') || '‐’−ー', '{N.MARKS}', '') AS word FROM {KANA_PARTS}")
def norm_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.regexp_replace("x", "ー", "・"), F.lit("‐’−ー"))
    return kana_parts(spark, sf_dir).select("p_partkey", N.marks(x).alias("word"))


def _folded_sql(x: str) -> str:
    x = sql_map(f"replace({x}, '　', '')", N.KATA_TO_HIRA)
    x = f"translate({sql_map(x, N.UPPER_WIDE)}, '{N.MARKS}', '')"
    x = LONG_SQL.replace("{x}", x)
    for t in (N.SOKUON, N.YOUON, N.SMALL_VOWELS, N.DAKUTEN, N.HANDAKUTEN):
        x = sql_map(x, t)
    return x


@query(f"SELECT p_partkey, {_folded_sql('x')} AS word, reverse({_folded_sql('x')}) AS backward FROM {KANA_PARTS}")
def norm_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in their order, as kana indexes apply them, forwards and backwards."""
    word = N.canonical(F.col("x"), N.KANA_STYLE)
    return kana_parts(spark, sf_dir).select("p_partkey", word.alias("word"), F.reverse(word).alias("backward"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {sql_map('x', N.KATA_TO_HIRA)} ELSE {sql_map(sql_map('x', N.HIRA_TO_KATA), N.DAKUTEN)} END AS word FROM {KANA_PARTS}")
def norm_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline with a style struct that differs from row to row."""
    even = F.col("p_partkey") % 2 == 0
    style = F.struct(*[F.lit(N.ASIS).alias(f) for f in N.KANA_STYLE if f not in ("katakana", "voiced_consonant", "space", "mark")], F.lit(3).alias("space"), F.lit(3).alias("mark"), F.when(even, 0).otherwise(2).alias("katakana"), F.when(even, 1).otherwise(0).alias("voiced_consonant"))
    return kana_parts(spark, sf_dir).select("p_partkey", N.canonical_by(F.col("x"), style).alias("word"))


#: A key and a word for each part: a beginning, a beginning in the other script, or the key itself.
PAIRS = f"(SELECT *, CASE p_partkey % 3 WHEN 0 THEN left(key, 3) WHEN 1 THEN left(hira, 4) ELSE key END AS word FROM (SELECT part.*, {KANA_SQL} AS key, {sql_map(KANA_SQL, N.KATA_TO_HIRA)} AS hira FROM part))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("key", kana(F.col("p_name")))
    n = F.col("p_partkey") % 3
    return p.withColumn("word", F.when(n == 0, F.substring("key", 1, 3)).when(n == 1, F.substring(N.to_hira(F.col("key")), 1, 4)).otherwise(F.col("key")))


@query(f"SELECT p_partkey, starts_with(key, word) AS hit FROM {PAIRS}")
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("p_partkey", M.prefix(F.col("key"), F.col("word")).alias("hit"))


@query(f"SELECT p_partkey, key = word AS hit FROM {PAIRS}")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys filled with NULs to a fixed length."""
    padded = F.concat("key", F.repeat(F.lit("\x00"), (F.col("p_size") % 3).cast("int")))
    return pairs(spark, sf_dir).select("p_partkey", M.exact(padded, F.col("word")).alias("hit"))


@query("SELECT p_partkey, rtrim(p_name || repeat(' ', p_size % 3)) = (CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END) AS hit FROM part")
def match_exact_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.concat("p_name", F.repeat(F.lit(" "), (F.col("p_size") % 3).cast("int")))
    return p.select("p_partkey", M.exact_latin(key, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))).alias("hit"))


@query(f"SELECT p_partkey, starts_with(translate(key, {TO_KATA}), translate(word, {TO_KATA})) AS hit FROM {PAIRS}")
def match_kana_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("p_partkey", M.kana_prefix(F.col("key"), F.col("word")).alias("hit"))


@query(f"SELECT p_partkey, translate(key, {TO_KATA}) = translate(word, {TO_KATA}) AS hit FROM {PAIRS}")
def match_kana_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("p_partkey", M.kana_exact(F.col("key"), F.col("word")).alias("hit"))


@query(f"SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' AND (p_size % 2 = 0 OR p_size % 3 = 0) THEN starts_with(translate(key, {TO_KATA}), translate(word, {TO_KATA})) ELSE starts_with(key, word) END AS hit FROM {PAIRS}")
def match_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "member").otherwise("single")
    hit = M.selected(kind, F.col("p_brand") == "Brand#1", F.col("p_size") % 2 == 0, F.col("key"), F.col("word"))
    return pairs(spark, sf_dir).select("p_partkey", hit.alias("hit"))


CARRY = f"(SELECT *, last_value(CASE kind WHEN 'header' THEN key WHEN 'single' THEN '-' END IGNORE NULLS) OVER (PARTITION BY subbook ORDER BY ord) AS g FROM {GROUPED})"


@query(f"SELECT ord, kind, CASE WHEN kind = 'header' OR (kind = 'member' AND g <> '-') THEN g END AS group_key FROM {CARRY}")
def win_carry_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.runs import grouped_entries

    return grouped_entries(grouped_parts(spark, sf_dir), ["subbook"]).select("ord", "kind", "group_key")


@query(f"SELECT ord, text FROM {CARRY} WHERE (kind = 'member' AND g <> '-' AND starts_with(g, left(key, 2)) AND starts_with(key, left(key, 2))) OR (kind = 'single' AND starts_with(key, left(key, 2)))")
def match_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members count where both their header and their own key begin with the word; singles by their key alone."""
    from ..operators.runs import grouped_entries

    g = grouped_entries(grouped_parts(spark, sf_dir), ["subbook"]).withColumn("word", F.substring("key", 1, 2))
    own = M.prefix(F.col("key"), F.col("word"))
    return g.where(((F.col("kind") == "member") & M.prefix(F.col("group_key"), F.col("word")) & own) | ((F.col("kind") == "single") & own)).select("ord", "text")


PATTERNS = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || '*' WHEN 2 THEN '*' || p_name WHEN 3 THEN '  * ' || p_name || ' ' WHEN 4 THEN '*' || p_name || '*' ELSE repeat('*', (p_size % 2 + 1)::INT) END AS t FROM part)"


@query(
    f"""SELECT p_partkey, CASE WHEN NOT two THEN CASE WHEN stars THEN '' ELSE trim(regexp_replace(b, '^\\*|\\*$', '', 'g')) END END AS word,
        CASE WHEN NOT two THEN starts_with(b, '*') END AS backward, CASE WHEN two THEN 'stars at both ends' END AS error
        FROM (SELECT *, regexp_matches(b, '^\\*{{1,2}}$') AS stars, starts_with(b, '*') AND suffix(b, '*') AND NOT regexp_matches(b, '^\\*{{1,2}}$') AS two FROM (SELECT p_partkey, trim(t) AS b FROM {PATTERNS}))"""
)
def parse_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, name = F.col("p_partkey") % 6, F.col("p_name")
    t = (
        F.when(n == 0, name).when(n == 1, F.concat(name, F.lit("*"))).when(n == 2, F.concat(F.lit("*"), name)).when(n == 3, F.concat(F.lit("  * "), name, F.lit(" ")))
        .when(n == 4, F.concat(F.lit("*"), name, F.lit("*"))).otherwise(F.repeat(F.lit("*"), (F.col("p_size") % 2 + 1).cast("int")))
    )
    return p.select("p_partkey", M.parsed_pattern(t).alias("x")).select("p_partkey", "x.*")
