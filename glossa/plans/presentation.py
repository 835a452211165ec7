"""Queries of the presentation functions, of codes, positions and glyph addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import present as P
from ..functions.normalize import ASCII_WIDE
from ..functions.normalize import mapped
from .corpora import sql_map
from .registry import query, spread, table

LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


@query(f"SELECT p_partkey, {sql_map(sql_map(chr(39) + '①−' + chr(39) + ' || p_name', ASCII_WIDE), P.FULL)} AS shown FROM part")
def pres_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = mapped(ASCII_WIDE)(F.concat(F.lit("①−"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", P.fold_width(wide).alias("shown"))


MEDIA = "(p_name || ' <sound=1:2>' || chr(10) || ' <image=' || p_size || ':x>' || chr(10) || p_brand || '<x=1:2>')"


@query(f"SELECT p_partkey, regexp_replace({MEDIA}, '(?m)^[ \\t　]*<(?:sound|image)=[^:>]*:[^>]*>\\n?|[ \\t　]*<(?:sound|image)=[^:>]*:[^>]*>', '', 'g') AS shown FROM part")
def pres_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("p_name", F.lit(" <sound=1:2>\n <image="), F.col("p_size").cast("string"), F.lit(":x>\n"), "p_brand", F.lit("<x=1:2>"))
    return table(spark, sf_dir, "part").select("p_partkey", P.drop_media(s).alias("shown"))


#: Case 0: a span in the word; case 1: a lone closing mark after it.
PITCH_SQL = "CASE WHEN p_partkey % 2 = 0 THEN left(p_name, 2) || regexp_replace(regexp_extract(substr(p_name, 3), '^[a-z]*'), '([a-z])', '\\1̅', 'g') || regexp_replace(substr(p_name, 3), '^[a-z]*', '') ELSE regexp_replace(string_split(p_name, ' ')[1], '([a-z])', '\\1̅', 'g') || ' ' || string_split(p_name, ' ')[2] END"


def _pitched() -> F.Column:
    words = F.split("p_name", " ")
    return F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 1, 2), F.lit("┏"), F.expr("substring(p_name, 3)"))).otherwise(F.concat(words[0], F.lit("┓ "), words[1]))


@query(f"SELECT p_partkey, {PITCH_SQL} AS shown FROM part")
def pres_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.pitch_accent(_pitched()).alias("shown"))


@query(f"SELECT p_partkey, {PITCH_SQL} AS shown FROM part")
def pres_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width text with a sound marker and pitch marks."""
    s = F.concat(mapped(ASCII_WIDE)(_pitched()), F.lit(" <sound=a:b>"))
    return table(spark, sf_dir, "part").select("p_partkey", P.readable(s).alias("shown"))


@query(f"SELECT doc_id, line_no, (length(line) + 4)::INT AS width FROM {LINES}")
def pres_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of lines with two wide characters and a combining one."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", P.display_width(F.concat("line", F.lit("辞́書"))).cast("int").alias("width"))


@query(f"SELECT doc_id, line_no, CASE WHEN length(line) <= 16 THEN line || CASE WHEN length(line) < 15 THEN '辞' ELSE '' END ELSE left(line, 16) END AS shown FROM {LINES}")
def pres_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", P.truncate(F.concat("line", F.lit("辞")), 16).alias("shown"))


@query(f"SELECT doc_id, line_no, rpad(line, 24, ' ') AS shown FROM {LINES}")
def pres_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", P.pad(F.col("line"), 24).alias("shown"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] || CASE WHEN length(string_split(p_name, ' ')[1]) < 6 THEN ' ' ELSE '' END || '|' || CASE WHEN length(string_split(p_name, ' ')[2]) <= 6 THEN string_split(p_name, ' ')[2] ELSE left(string_split(p_name, ' ')[2], 6) || '|' || substr(string_split(p_name, ' ')[2], 7) END AS shown FROM part")
def pres_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names in lines of six columns."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(P.wrap_lines(F.col("p_name"), 6), "|").alias("shown"))


@query("SELECT p_partkey, printf('%3d. %s    [%d:%d]', (p_partkey % 50)::INT, trim(replace(' ' || p_name || chr(10) || 'x', chr(10), ' ')), p_partkey // 7 + 1, p_size) AS shown FROM part")
def pres_hit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.concat(F.lit(" "), "p_name", F.lit("\nx"))
    page = F.expr("p_partkey DIV 7 + 1")
    return table(spark, sf_dir, "part").select("p_partkey", P.hit_line(F.col("p_partkey") % 50, heading, page, F.col("p_size")).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS page, CASE WHEN p_partkey % 3 < 2 THEN p_size::BIGINT END AS offset FROM part")
def parse_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as typed, every third one malformed."""
    n = F.col("p_partkey") % 3
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    s = F.when(n == 0, F.concat(key, F.lit(":"), size)).when(n == 1, F.concat(F.lit(" "), key, F.lit(": "), size)).otherwise(F.concat(key, F.lit(":"), size, F.lit(":1")))
    return table(spark, sf_dir, "part").select("p_partkey", P.parsed_position(s).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '百' WHEN 1 THEN '英' WHEN 2 THEN '国' ELSE '英' END AS category FROM part")
def pres_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    title = F.when(n == 0, F.concat("p_name", F.lit("英和 Ｅｎｃｙｃｌｏｐｅｄｉａ"))).when(n == 1, F.concat("p_name", F.lit("新和英"))).when(n == 2, F.col("p_name")).otherwise(F.concat(F.lit("ＲＯＧＥＴ "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", P.title_category(title).alias("category"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN translate(p_size::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') WHEN 1 THEN '(' || p_name || ')' ELSE '' END AS shown FROM part")
def text_subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    s = F.when(n == 0, F.col("p_size").cast("string")).when(n == 1, F.col("p_name")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", P.subscript(s).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS number FROM part")
def bcd_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bytes of packed decimal; odd rows have a digit that isn't decimal."""
    digits = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    data = F.unhex(F.when(F.col("p_partkey") % 2 == 0, digits).otherwise(F.concat(F.lit("A"), F.expr("substring(lpad(cast(p_partkey AS string), 8, '0'), 2)"))))
    return table(spark, sf_dir, "part").select("p_partkey", C.bcd(data).alias("number"))


@query("SELECT p_partkey, (p_partkey % 97) * 2048 + p_size AS location, p_partkey % 97 + 1 AS page, p_size AS offset FROM part")
def pos_to_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = C.location(F.col("p_partkey") % 97 + 1, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", loc.alias("location"), C.position(loc).alias("x")).select("p_partkey", "location", "x.*")


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 'h' ELSE 'z' END) || lpad(lower(hex(41249 + p_partkey % 500)), 4, '0') AS name FROM part")
def gaiji_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.gaiji_name(F.col("p_size") % 2 == 0, F.col("p_partkey") % 500 + 41249).alias("name"))


@query("SELECT p_partkey, (161 + p_partkey // 94) * 256 + 33 + p_partkey % 94 AS code FROM part")
def gaiji_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive cells from A121 on."""
    return table(spark, sf_dir, "part").select("p_partkey", C.cell_after(F.lit(0xA121).cast("long"), F.col("p_partkey")).alias("code"))


@query(
    """SELECT p_partkey, CASE WHEN latin AND e % 256 > 254 THEN e + 3 WHEN NOT latin AND e % 256 > 126 THEN e + 163 ELSE e END AS last FROM (
        SELECT p_partkey, latin, 41249 + (n // per) * 256 + n % per - 1 AS e FROM (SELECT p_partkey, p_size % 2 = 0 AS latin, p_partkey % 700 + 1 AS n, CASE WHEN p_size % 2 = 0 THEN 254 ELSE 94 END AS per FROM part))"""
)
def font_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = C.font_last(F.lit(0xA121).cast("long"), F.col("p_partkey") % 700 + 1, F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", last.alias("last"))


@query("SELECT p_partkey, ((p_partkey // (1024 // s)) * 1024 + p_partkey % (1024 // s) * s)::BIGINT AS address FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 16 WHEN 1 THEN 48 WHEN 2 THEN 60 ELSE 144 END AS s FROM part)")
def font_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of narrow glyphs of four heights."""
    n, sizes = F.col("p_size") % 4, list(C.GLYPH_BYTES["narrow"].values())
    size = F.when(n == 0, sizes[0]).when(n == 1, sizes[1]).when(n == 2, sizes[2]).otherwise(sizes[3])
    return table(spark, sf_dir, "part").select("p_partkey", C.glyph_address(F.col("p_partkey"), size).alias("address"))


@query("SELECT p_partkey, i, (161 + i // 94) * 256 + 33 + i % 94 AS code FROM (SELECT p_partkey, unnest(range(0, p_size * 5)) AS i FROM part)")
def font_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes of a font for each part, as many as five times its size."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long") * 5 - 1)).alias("i"))
    return p.select("p_partkey", "i", C.cell_after(F.lit(0xA121).cast("long"), F.col("i")).alias("code"))


@query(
    """SELECT p_partkey, list_aggregate(list_transform(range(0, 16), lambda r: translate(lpad(((p_partkey * (r + 1) * 37) % 256)::INT::VARCHAR, 1, '0')[1:0] || list_aggregate(list_transform(range(0, 8), lambda b: (((p_partkey * (r + 1) * 37) % 256)::INT >> (7 - b)::INT) & 1), 'string_agg', ''), '01', '·█')), 'string_agg', chr(10)) AS shown FROM part"""
)
def font_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of 8 by 16 made of each part's number."""
    byte = lambda r: F.lpad(F.hex((F.col("p_partkey") * (r + 1) * 37) % 256), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), byte), ""))
    p = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return p.select("p_partkey", C.raster(data, F.lit(8)).alias("shown"))


@query("SELECT p_partkey, '50340A3' || (p_size % 10) || '2032310A' || upper(hex(rpad(p_name, 21, 'x'))) AS file FROM part")
def font_pbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of one byte a row, made of names, as files in hexadecimal."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.hex(C.pbm(F.encode(F.rpad("p_name", 21, "x"), "US-ASCII"), F.col("p_size") % 10, F.lit(21))).alias("file"))


