"""Personal data: base kinds by pattern, and bootstrapped contextual extraction of further identifiers.

Base entities and secrets are seeds. The one, two and three words before an identifier-like token are its lexical
patterns; patterns and the tokens that they precede make a bipartite graph. A pattern's confidence is the mean
score of its distinct tokens: 1 for a known identifier, for an unseen token the mean confidence of its other
patterns, and so on for a few rounds. Tokens behind patterns of high confidence are identifiers too. All of it is
DataFrame expressions: matches are rows, and positions and overlaps are running sums and maxima over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: The base kinds in their order. Possessive where backtracking can't help; the lookbehinds only
#: skip starts inside a run whose beginning was tried already.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What ends a token, besides white space.
BREAKS = r"\"'<>()\[\]{}|,;:=#&$*"
SECRET = (
    r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    rf"|(?<=(?:password|passwd|secret|api_key)=)[^\x20\x09-\x0D%{BREAKS}]{{8,}}+"
)
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Identifier-like tokens: whole runs of 8 characters or more without white space or breaks in which a digit stands.
TOKEN = rf"(?<![^\x20\x09-\x0D{BREAKS}])(?=[^\x20\x09-\x0D0-9{BREAKS}]*+[0-9])[^\x20\x09-\x0D{BREAKS}]{{8,}}+"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(m))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


FOUND = "array<struct<kind:int,nth:int,gap:int,m:string,tail:string>>"


def matches(text: Column, kind: int, pattern: str, reach: int) -> Column:
    """The non-overlapping matches from the left: kind, number, code points since the last match, match, and the end of what stands between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.filter(F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("between")), lambda x: x["m"].isNotNull())
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["between"]).alias("gap"), x["m"].alias("m"), F.right(x["between"], F.lit(reach)).alias("tail")
        ),
    )


def patterns_before(before: Column, words: int = 3) -> Column:
    """The last one, two, ... words before a token, lower-cased, digits as 0; a piece that touches the token is a word."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(before), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0")
    apart = F.when(plain.endswith(" "), " ").otherwise("")
    each = F.array(*[F.concat(F.substring_index(F.rtrim(plain), " ", -k), apart) for k in range(1, words + 1)])
    return F.filter(F.array_distinct(each), lambda x: F.trim(x) != "")


def found_entities(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """rk, doc_id and found: the matches of all kinds, and as kind 5 identifier-like tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("rk", F.monotonically_increasing_id())
    text = F.col("text")
    # The guards are cheap, and CASE leaves the dear branch alone where they fail.
    guarded = [
        (EMAIL, text.contains("@")),
        (IP, text.rlike(r"[0-9]\.[0-9]")),
        (CARD, text.rlike("[0-9][ -]?[0-9]")),
        (PHONE, text.rlike(r"\+[0-9]")),
        (SECRET, text.rlike("[0-9A-Fa-f]{32}|AKIA[0-9A-Z]|password=|passwd=|secret=|api_key=")),
        (TOKEN, text.rlike("[0-9]")),
    ]
    arrays = [F.when(guard, matches(text, i, pattern, reach if i == 5 else 0)).otherwise(F.array().cast(FOUND)) for i, (pattern, guard) in enumerate(guarded)]
    return rows.select("rk", "doc_id", F.concat(*arrays).alias("found"))


def marked(found: DataFrame, reach: int) -> DataFrame:
    """rk, kind, start, stop of valid spans, and of tokens (kind 5) also token, patterns and seed: whether it meets a span."""
    rows = found.select("rk", F.explode("found").alias("x")).select("rk", "x.*").repartition("rk")
    order = Window.partitionBy("rk", "kind").orderBy("nth")
    stop = F.sum(F.col("gap") + F.length("m")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # A token has 8 characters at least, so this many tokens before it hold what its patterns can reach.
    earlier = F.array_join(F.collect_list(F.concat("tail", "m")).over(order.rowsBetween(-(reach // 8 + 1), -1)), "")
    before = F.when(F.col("kind") == 5, F.concat(earlier, "tail"))
    rows = rows.withColumns({"start": stop - F.length("m"), "before": F.right(before, F.lit(reach))})
    is_token = F.col("kind") == 5
    valid = F.lit(True)
    for i, kind in enumerate(KINDS[:4]):
        valid = F.when(F.col("kind") == i, _valid(kind, F.col("m"))).otherwise(valid)
    token = F.when(is_token, F.rtrim("m", F.lit(".!?%")))
    rows = rows.where(valid).select("rk", "kind", "start", (F.col("start") + F.length(F.coalesce(token, "m"))).alias("stop"), token.alias("token"), F.when(is_token, patterns_before(F.col("before"))).alias("patterns"))
    spans = lambda c: F.when(F.col("kind") < 5, F.col(c))
    upto = Window.partitionBy("rk").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("rk").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"last": F.max(spans("stop")).over(upto), "next": F.min(spans("start")).over(since)})
    seed = is_token & (F.coalesce(F.col("last") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("stop"), F.lit(False)))
    return rows.withColumn("seed", seed).drop("last", "next")


def pattern_scores(occurrences: DataFrame, rounds: int = 3) -> DataFrame:
    """pattern, confidence, support: scores of the pattern-instance graph. occurrences: patterns, token, seed.

    A token is known where it is a seed anywhere. A pattern's confidence is the mean score of its distinct
    tokens, its support the number of its known ones. An unseen token without another pattern scores 0.
    """
    each = occurrences.select(F.explode("patterns").alias("pattern"), "token", F.col("seed").cast("int").alias("seed"))
    edges = written(each.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
    known = written(edges.groupBy("token").agg(F.max("seed").alias("known")), "known")
    edges = written(edges.drop("seed").join(known, "token"), "graph")

    def scores_of(scored: DataFrame) -> DataFrame:
        return written(scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum("known").alias("support")), "scores")

    scores = scores_of(edges.withColumn("score", F.col("known").cast("double")))
    for _ in range(rounds - 1):
        rated = written(edges.join(scores.select("pattern", "confidence"), "pattern"), "rated")
        sums = written(rated.where("known = 0").groupBy("token").agg(F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1"), "sums")
        others = (F.col("total") - F.col("confidence")) / (F.col("k") - 1)
        score = F.when(F.col("known") == 1, 1.0).otherwise(F.coalesce(others, F.lit(0.0)))
        scores = scores_of(rated.join(sums, "token", "left").withColumn("score", score))
    return scores


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    confidence: float = 0.5,
    support: int = 5,
    min_digits: int = 4,
    min_length: int = 12,
    reach: int = 64,
) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_id, n_spans.

    spans lists kind:start:stop of all kinds by start, then kind: the base kinds, ``secret`` (32 or more
    hexadecimal digits, access key ids, and values assigned to a password or secret) and ``id``: tokens of at
    least ``min_length`` characters and ``min_digits`` digits behind a pattern of enough confidence and support,
    which overlap no other span. Patterns are taken from the last ``reach`` characters before a token. Positions
    are in code points. Null texts are empty and have no spans: base_sha256 is then that of the empty string.
    Ids pass through, null or repeated; other columns aren't read; an empty table gives an empty result.
    """
    found = written(found_entities(docs, id_col, text_col, reach), "entities")
    marks = written(marked(found, reach), "marks")
    tokens = marks.where("kind = 5")
    scores = pattern_scores(tokens, rounds)
    good = written(scores.where((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern"), "good")
    unseen = tokens.where(~F.col("seed") & (F.length("token") >= min_length) & (F.length(_digits(F.col("token"))) >= min_digits))
    new = unseen.select("rk", "start", "stop", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").select("rk", F.lit(5).alias("kind"), "start", "stop").distinct()
    spans = marks.where("kind < 5").select("rk", "kind", "start", "stop").unionByName(new)
    spans = spans.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
    out = found.select("rk", "doc_id").join(spans, "rk", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")))
    names = F.array(*map(F.lit, KINDS))

    def joined(found_spans: Column) -> Column:
        return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    base = F.filter("all", lambda s: s["kind"] < 4)
    return out.select(
        F.col("doc_id").alias(id_col),
        *map(count, range(4)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        count(4),
        count(5),
        F.size("all").cast("long").alias("n_spans"),
    )
