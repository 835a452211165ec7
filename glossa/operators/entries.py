"""Decoding entries: a byte stream becomes rows of tokens, and windows over an entry's tokens carry its state.

Input: entry (its number) and bytes, an entry's bytes from its position on, 64 KiB at most. A token is a character, an
escape with its argument, or a region that is skipped whole. All rules are in one pattern over hexadecimal digits.
Characters take two bytes (JIS X 0208, GB 2312 or private), in Latin books one, or two if they are private.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.codes import gaiji_name
from ..functions.jis import GB
from ..functions.present import subscript
from ..sources.discs import jis_char
from .stored import written

#: Bytes after an escape's code, by code; escapes that aren't listed have none.
ARGUMENTS = {0x09: 2, 0x41: 2, 0x4C: 2, 0x39: 44, 0x3C: 18, 0x4D: 18, 0x44: 10, 0x4F: 32, 0x52: 6, 0x62: 6, 0x63: 6, 0x64: 6, 0x53: 8}
OPTIONAL = [*range(0x1A, 0x20), 0xE0]
#: Escapes that begin a skipped region, with the one that ends it.
SKIPS = {c: c + 0x20 for c in [*range(0x35, 0x39), 0x3A, 0x3B, *range(0x3D, 0x40), 0x49, 0x4E, *range(0x70, 0x90)]} | {c: c + 1 for c in [0xE4, *range(0xE6, 0xFF, 2)]} | {0x14: 0x15}


#: The most bytes that an entry is read for, and how many bytes of entries a task takes: its tokens' rows take some hundred times as much.
MOST = 1 << 16
TASK_BYTES = 2 << 20


def token_pattern(epwing: bool = True, latin: bool = False) -> str:
    """One alternative for each kind of token, over upper-case hexadecimal digits, in the order in which they are tried."""
    skip = [f"1F{a:02X}(?:(?!1F{b:02X}|1F03)..)*+(?:1F{b:02X})?+" for a, b in SKIPS.items()]
    fixed = [f"1F{c:02X}.{{{2 * n}}}" for c, n in ARGUMENTS.items()]
    optional = [f"1F{c:02X}" + ("...." if epwing else "(?:(?:0.|1[0-9A-E])..)?+") for c in OPTIONAL]
    special = ["1F4B.{12}(?:1F6B)?+", "1F4200..", "1F.."]
    chars = ["[2-6].|7[0-9A-E]|[A-F].", "....", ".."] if latin else ["[2-9A-F]...", ".."]
    return "|".join([*skip, *fixed, *optional, *special, *chars])


def dealt(entries: DataFrame) -> DataFrame:
    """entry and bytes, written and dealt out by entry, so that a task has about ``TASK_BYTES`` however many there are. Windows over tokens keep to that."""
    rows = written(entries.select("entry", "bytes"), "entries")
    total = rows.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    return rows.repartition(total // TASK_BYTES + 1, "entry")


def tokens(entries: DataFrame, epwing: bool = True, latin: bool = False) -> DataFrame:
    """entry, pos, at (byte place in the entry), token (hexadecimal), chars (how many characters it holds: in a skipped region some)."""
    pattern = token_pattern(epwing, latin)
    found = F.regexp_extract_all(F.hex("bytes"), F.lit(pattern), F.lit(0))
    each = dealt(entries).select("entry", F.posexplode(found).alias("pos", "token"))
    order = Window.partitionBy("entry").orderBy("pos")
    before = F.coalesce(F.sum(F.length("token") / 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    escape = F.startswith("token", F.lit("1F"))
    inner = F.regexp_extract_all(F.expr("substring(token, 5)"), F.lit(pattern), F.lit(0))
    skipped = escape & F.substring("token", 3, 2).isin(*(f"{c:02X}" for c in SKIPS))
    chars = F.when(skipped, F.size(F.filter(inner, lambda x: ~F.startswith(x, F.lit("1F"))))).when(escape, 0).otherwise(1)
    return each.withColumns({"at": before.cast("long"), "chars": chars})


def _code(token: Column) -> Column:
    """An escape's code in hexadecimal, null for characters."""
    return F.when(F.startswith(token, F.lit("1F")), F.substring(token, 3, 2))


def stop_token(code: Column, argument: Column) -> Column:
    """An escape with its argument, as the token that it is read as."""
    return F.concat(F.lpad(F.hex(code), 4, "0"), F.lpad(F.hex(argument), 4, "0"))


def read_end(data: Column, stop: Column) -> Column:
    """(stop, next) of an entry's bytes, as in entry_texts, without its text: one fold over its tokens. stop: the token that ends it."""
    found = F.regexp_extract_all(F.hex(data), F.lit(token_pattern()), F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        code = _code(t)
        soft = (acc["printed"] & (t == stop)) | (code == "6C") | ((code == "4B") & (F.length(t) == 20))
        ends = F.when(code == "03", "hard").when(soft, "soft")
        inner = F.regexp_extract_all(F.substring(t, F.lit(5), F.length(t)), F.lit(token_pattern()), F.lit(0))
        skipped = code.isin(*(f"{c:02X}" for c in SKIPS))
        chars = F.when(code.isNull(), True).when(skipped, F.exists(inner, lambda x: ~F.startswith(x, F.lit("1F")))).otherwise(False)
        after = acc["at"] + F.floor(F.length(t) / 2)
        moved = F.struct(F.when(ends == "hard", acc["at"]).otherwise(after).alias("at"), (acc["printed"] | chars).alias("printed"), ends.alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("printed"), F.lit(None).cast("string").alias("stop"))
    kind = lambda acc: F.coalesce(acc["stop"], F.when(acc["at"] >= MOST, "none").otherwise("hard"))
    return F.aggregate(found, start, step, lambda acc: F.struct(kind(acc).alias("stop"), acc["at"].alias("next")))


def events(toks: DataFrame, stop: tuple[int, int] | Column | None = None, heading: bool = False, latin: bool = False) -> DataFrame:
    """tokens with kind, shown text, its place in the output, region (how many subscripts began up to there), and only up to the entry's end; stops keep a row of kind ``stop``.

    stop: the escape and argument that begin the next entry, or a column with their token. Without one, an entry ends where the keyword escape that opened
    it comes again. Neither counts before the first character, nor in headings, which a line end ends.
    """
    order = Window.partitionBy("entry").orderBy("pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("token")
    code = F.col("code")
    lead = F.conv(F.substring("token", 1, 2), 16, 10).cast("int")
    rows = toks.withColumn("code", _code(t)).withColumn("lead", lead)
    rows = rows.withColumns({"printed": F.sum("chars").over(before), "opener": F.first(F.when(code == "41", t), True).over(before)})
    if isinstance(stop, Column):
        hit = t == F.coalesce(stop, F.col("opener"))
    else:
        hit = (t == f"1F{stop[0] & 0xFF:02X}{stop[1]:04X}") if stop else (t == F.col("opener"))
    ends = ~F.lit(heading) & (F.coalesce(F.col("printed"), F.lit(0)) > 0) & F.coalesce(hit, F.lit(False))
    hard = code == "03"
    soft = ends | (code == "6C") | ((code == "4B") & (F.length(t) == 20)) | (F.lit(heading) & (code == "0A"))
    rows = rows.withColumn("ends", F.when(hard, "hard").when(soft, "soft"))
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("ends").isNotNull().cast("int")).over(before), F.lit(0))).where("over = 0")
    last = lambda opens, closes: F.coalesce(F.last(F.when(code == opens, True).when(code == closes, False), True).over(upto), F.lit(False))
    opened = F.sum(F.when(code == "06", 1).otherwise(0)).over(upto)
    rows = rows.withColumns({"narrow": last("04", "05"), "region": opened, "sub": last("06", "07")})
    number = F.conv(F.substring("token", 1, 4), 16, 10).cast("long")
    trail, pair = number % 256, F.length(t) == 4
    jis = code.isNull() & pair & F.col("lead").between(0x21, 0x7E) & trail.between(0x21, 0x7E)
    gb = code.isNull() & pair & F.col("lead").between(0x21, 0x7E) & trail.between(0xA1, 0xFE)
    gaiji = code.isNull() & pair & F.col("lead").between(0xA1, 0xFE) & trail.between(0x21, 0x7E)
    char = F.when(jis, jis_char(number)).when(gb, F.substring(F.lit(GB), ((F.col("lead") - 0x21) * 94 + trail - 0xA1 + 1).cast("int"), F.lit(1)))
    name = gaiji_name(F.lit(True) if latin else F.col("narrow"), number)
    if latin:
        gaiji, char = code.isNull() & pair, F.when(code.isNull() & (F.length(t) == 2), F.decode(F.unhex(t), "ISO-8859-1"))
    kind = F.when(char.isNotNull(), "char").when(gaiji, "gaiji").when(F.col("ends").isNotNull(), "stop").when(code == "0A", "newline").when(code.isNotNull(), "escape").otherwise("stray")
    shown = F.when(char.isNotNull(), char).when(gaiji, F.concat(F.lit("<gaiji="), name, F.lit(">"))).when(kind == "newline", "\n").otherwise("")
    if latin:
        rows = rows.withColumn("narrow", F.lit(True))
    rows = rows.withColumns({"kind": kind, "shown": shown, "number": F.when(gaiji, number)})
    # Subscript regions are shown as a whole, where they end. They are numbered along pos, so one sort by both serves this window and those after it.
    whole = Window.partitionBy("entry", "region").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("within", F.collect_list(F.when(F.col("sub"), F.col("shown"))).over(whole))
    shown = F.when(code == "07", subscript(F.array_join("within", ""))).when(F.col("sub"), "").otherwise(F.col("shown"))
    start = F.coalesce(F.sum(F.length("shown")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("shown", shown).withColumn("start", start.cast("int")).drop("over", "sub", "within", "printed", "opener", "lead", "chars")


def in_order() -> WindowSpec:
    """An entry's events in their order, sorted as ``events`` leaves them."""
    return Window.partitionBy("entry").orderBy("region", "pos")


def entry_texts(ev: DataFrame, most: int = MOST) -> DataFrame:
    """entry, text, stop (none, soft or hard), next (byte place of what follows), unknown (private codes in use)."""
    grouped = ev.groupBy("entry").agg(
        F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("parts"),
        F.max("ends").alias("ends"),
        F.max(F.when(F.col("ends") == "hard", F.col("at")).otherwise(F.col("at") + F.length("token") / 2)).cast("long").alias("next"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "gaiji", gaiji_name(F.col("narrow"), F.col("number"))))).alias("unknown"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    # A stream that ends without an escape ends hard as well; one that is cut at the most bytes doesn't end.
    stop = F.coalesce("ends", F.when(F.col("next") >= most, "none").otherwise("hard"))
    return grouped.select("entry", text.alias("text"), stop.alias("stop"), "next", F.array_join("unknown", ",").alias("unknown"))


def spans(ev: DataFrame, opens: str, closes: str) -> DataFrame:
    """entry, start, end, page, offset of references (42, 62) or menu lines (43, 63); a target of zeros is null."""
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("code") == opens, F.col("start")), True).over(upto)
    rows = ev.withColumn("from", begun).where(F.col("code") == closes)
    page, offset = F.substring("token", 5, 8).try_cast("long"), F.substring("token", 13, 4).try_cast("int")
    there = (page != 0) | (offset != 0)
    return rows.select("entry", F.col("from").alias("start"), F.col("start").alias("end"), F.when(there, page).alias("page"), F.when(there, offset).alias("offset"))
