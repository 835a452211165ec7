"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domain, language and source. At each node it is shared out by weight; a
child that can't use its share leaves the shortage to its siblings, and only what a whole node can't use
reaches the siblings of its parent. Each leaf then takes whole epochs and a token-prefix of one more, whose
order is seeded. Only figures per leaf and per chunk of a leaf are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

LEVELS = ("domain", "language", "leaf")


def weight_of(col: Column, weights: Mapping[str, int], default: int) -> Column:
    """Integer weights by name; a name that isn't listed has the default."""
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(col.eqNullSafe(F.lit(name)), F.lit(w)).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``alloc`` to nodes with weight, cap and the parent's budget.

    Children are filled in the order of cap / weight: one is full when its cap is at most its share of what
    those before it have left. The others share the rest by weight, in whole tokens that sum to it.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap") / F.greatest(F.col("weight"), F.lit(1))).asc(), F.col(name).asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") * onward <= F.col("weight") * (F.col("budget") - before)
    named = by.orderBy(F.col(name).asc())
    return (
        nodes.withColumn("is_full", full)
        .withColumn("open", F.when(F.col("is_full"), 0).otherwise(F.col("weight")))
        .withColumns(
            {
                "rest": F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(by),
                "all_open": F.greatest(F.sum("open").over(by), F.lit(1)),
                "upto": F.sum("open").over(named.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .withColumn("alloc", F.when(F.col("is_full"), F.col("cap")).otherwise(F.expr("rest * upto DIV all_open - rest * (upto - open) DIV all_open")))
        .drop("is_full", "open", "rest", "all_open", "upto", "budget")
    )


def budgets(leaves: DataFrame, total: int) -> DataFrame:
    """domain, language, leaf, tokens, n_docs, alloc. leaves: also w_domain, w_language, w_leaf and cap."""
    usable = F.when((F.col("w_domain") > 0) & (F.col("w_language") > 0) & (F.col("w_leaf") > 0), F.col("cap")).otherwise(0)
    leaves = leaves.withColumn("cap", usable)
    alloc: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        path, up = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{name}").alias("weight"))
        if alloc is None:
            all_caps = F.sum("cap").over(Window.partitionBy())
            nodes = nodes.withColumn("budget", F.least(F.lit(total).cast("long"), all_caps))
        else:
            nodes = nodes.join(alloc.select(*up, F.col("alloc").alias("budget")), up)
        alloc = shared_out(nodes, up, name)
    return leaves.select(*LEVELS, "tokens", "n_docs").join(alloc.select(*LEVELS, "alloc"), list(LEVELS))


def mix(
    docs: DataFrame,
    domain: Column,
    domain_weights: Mapping[str, int],
    language_weights: Mapping[str, int],
    source_weights: Mapping[str, int] | None = None,
    budget: int | None = None,
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 2,
    seed: int = 7,
    default_weight: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    chunk_rows: int = 256,
) -> DataFrame:
    """docs' columns, domain and epoch: one row per document and epoch in which it is drawn.

    A text's tokens are its words. budget: tokens; without it the ``share`` of all tokens. A leaf gives each
    document at most ``max_epochs`` times; tokens that no leaf can give stay undrawn. In the last, partial
    epoch documents come in the order of md5(seed:epoch:id), and those up to which the tokens fit are drawn;
    rows that repeat an id are drawn together. Null names count as empty ones, a null id as an empty
    string, a null text as an empty one; documents without words fill no budget: they come with a full or partial
    epoch of their leaf, and not at all from a leaf without tokens. An empty table gives an empty result.
    Columns named domain or epoch are replaced, others
    keep their values; long texts are read for their words alone.
    """
    part = lambda c: F.coalesce(F.col(f"doc.`{c}`").cast("string"), F.lit(""))
    # The expression for the domain reads docs' own columns.
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"))
    keyed = at.select("doc", "domain", part(lang_col).alias("language"), part(source_col).alias("leaf"), part(id_col).alias("id"))
    n_tokens = F.regexp_count(text_or_empty(F.col(f"doc.`{text_col}`")), F.lit(WORD)).cast("long")
    light = written(keyed.select("domain", "language", "leaf", "id", n_tokens.alias("n_tokens")), "tokens")

    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    leaves = written(leaves, "leaves")
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    weighed = leaves.withColumns(
        {
            "w_domain": weight_of(F.col("domain"), domain_weights, default_weight),
            "w_language": weight_of(F.col("language"), language_weights, default_weight),
            "w_leaf": weight_of(F.col("leaf"), source_weights or {}, default_weight),
            "cap": F.col("tokens") * max_epochs,
        }
    )
    plan = budgets(weighed, budget).select(
        *LEVELS,
        F.expr("coalesce(alloc DIV nullif(tokens, 0), 0)").alias("full"),
        F.expr("coalesce(alloc % nullif(tokens, 0), 0)").alias("rest"),
        F.ceil(F.col("n_docs") / chunk_rows).cast("long").alias("chunks"),
    )
    plan = written(plan, "plan")

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("id")))
    chunk = F.expr("conv(substring(o, 1, 8), 16, 10)::bigint * chunks DIV 4294967296")
    rows = light.join(plan.where("rest > 0"), list(LEVELS)).withColumn("o", draw).withColumn("chunk", chunk)
    sums = rows.groupBy(*LEVELS, "chunk", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("chunk"))
    crossed = sums.withColumn("upto", upto).where("upto > rest AND upto - t <= rest")
    crossed = written(crossed.groupBy(*LEVELS).agg(F.min(F.struct("chunk", (F.col("upto") - F.col("t")).alias("before"))).alias("x")).select(*LEVELS, "x.*"), "crossed")
    inside = rows.join(crossed, [*LEVELS, "chunk"])
    got = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "chunk").orderBy("o"))
    last = inside.withColumn("got", got).where("got <= rest").groupBy(*LEVELS).agg(F.max("o").alias("last"))
    drawn = plan.join(crossed.drop("before"), list(LEVELS), "left").join(last, list(LEVELS), "left")
    drawn = written(drawn.select(*LEVELS, "full", "rest", "chunks", F.col("chunk").alias("edge"), F.coalesce("last", F.lit("")).alias("last")), "drawn")

    out = keyed.join(drawn, list(LEVELS)).withColumn("o", draw).withColumn("chunk", chunk)
    partial = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("chunk") < F.col("edge")) | ((F.col("chunk") == F.col("edge")) & (F.col("o") <= F.col("last"))))
    times = F.col("full") + F.when(partial, 1).otherwise(0)
    out = out.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    kept = [c for c in docs.columns if c not in ("domain", "epoch")]
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in kept], "domain", "epoch")
