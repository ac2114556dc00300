"""Mixing sources to target weights: raking token weights, then sampling by probability.

The tokens of all documents are summed into cells of (first column, other columns). Raking
scales the cells, margin after margin, until every margin has its target shares. The
first column (the source) may have any number of values and stays distributed: one row a
value, with its cells. The others must be few in combination, which is checked; their
factors are small lists, and a round is one job that returns one number a combination.

A document is taken with a probability in proportion to its cell's factor. With a budget (a
share of all tokens) the probability is min(1, a * factor), and a is solved over all cells so that
the expected tokens are the budget; a rare value then can't shrink all others. Cells of
probability 1 stay below their targets unless rows may be repeated: then a row is taken
a * factor times on average, and the expected margins are the targets. Without a budget the largest
factor gets probability 1, so the expected margins are the targets exactly, and the smallest
cell decides how much is kept. The draw is a
hash of the document and the seed: the same in a repeated task, and independent of
the plan. Documents are read twice and never shuffled.

Targets: shares by value, or where none are given the measured shares to the power of
``temper``, normalised. Values without a share get none and are never taken.

Defined results: a null in a column counts as an empty value. A null text counts as
empty. A document has its number of separators (blanks, line ends, tabs) + 1 as tokens. Equal
rows have equal fates. Margins that no weights can meet are approached for
``rounds`` rounds. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut

#: Combinations of all columns but the first.
MOST_COMBINATIONS = 10_000


def token_count(text: Column) -> Column:
    bare = F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), F.lit("\t"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(bare) + 1).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from the form of a text: table, links, lines or prose."""
    size = F.greatest(F.octet_length(text), F.lit(1))
    share = lambda sign: (size - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))) / size
    return (
        F.when(share("|") > 0.01, "table")
        .when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("@")), "links")
        .when(share("\n") > 0.008, "lines")
        .otherwise("prose")
    )


def _shares(found: dict, given: dict | None, temper: float) -> dict:
    if given is not None:
        kept = {k: float(given.get(k, 0.0)) for k in found}
    else:
        kept = {k: float(n) ** temper if n > 0 else 0.0 for k, n in found.items()}
    total = sum(kept.values())
    return {k: v / total if total else 0.0 for k, v in kept.items()}


def raked(cells: DataFrame, first: str, others: list[str], targets: dict[str, dict] | None = None, temper: float = 0.7, rounds: int = 60, close: float = 1e-6) -> DataFrame:
    """``cells`` (first, others, n) with ``factor``: what to multiply each cell's share by. A written table, read often."""
    spark, targets = cells.sparkSession, targets or {}
    combos = [tuple(r) for r in cells.select(*others).distinct().orderBy(*others).limit(MOST_COMBINATIONS + 1).collect()]
    if len(combos) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of {others}")
    if not combos:
        return cells.withColumn("factor", F.lit(0.0))
    index = spark.createDataFrame([(*c, i) for i, c in enumerate(combos)], [*others, "_at"])
    rows = cells.join(F.broadcast(index), others)  # MOST_COMBINATIONS rows at most
    total = cells.agg(F.sum("n")).first()[0]
    margins = []
    for k, column in enumerate(others):
        found = {}
        for r in cells.groupBy(column).agg(F.sum("n").alias("n")).collect():
            found[r[0]] = r.n
        margins.append((k, _shares(found, targets.get(column), temper)))
    own = rows.groupBy(first).agg(F.sum("n").alias("n"), F.collect_list(F.struct("_at", (F.col("n") / F.lit(float(total))).alias("share"))).alias("cells"))
    if first in targets:
        goal = spark.createDataFrame([(k, float(v)) for k, v in targets[first].items()], [first, "_goal"])
        own = own.join(goal, first, "left").withColumn("_goal", F.coalesce("_goal", F.lit(0.0)))
    else:
        own = own.withColumn("_goal", F.pow(F.col("n").cast("double"), F.lit(temper)))
    own = cut(own, "rake")
    own = own.withColumn("_goal", F.col("_goal") / F.lit(own.agg(F.sum("_goal")).first()[0] or 1.0))

    def inside(factors: list[float]) -> Column:
        table = F.array(*[F.lit(f) for f in factors])
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["share"] * F.get(table, c["_at"].cast("int")))

    scale = lambda factors: F.when(inside(factors) > 0, F.col("_goal") / inside(factors)).otherwise(0.0)
    factor = [dict.fromkeys(m, 1.0) for _, m in margins]
    joint = [1.0] * len(combos)
    before = joint
    for _ in range(rounds):
        moved = F.when(inside(before) > 0, F.abs(inside(joint) / inside(before) - 1)).otherwise(0.0)
        each = own.select(scale(joint).alias("_a"), moved.alias("_moved"), F.explode("cells").alias("c"))
        got = each.groupBy(F.col("c._at").alias("at")).agg(F.sum(F.col("_a") * F.col("c.share")).alias("w"), F.max("_moved").alias("moved")).collect()
        weight = [0.0] * len(combos)
        for r in got:
            weight[r.at] = r.w
        off = 0.0
        for k, goal in margins:
            for value, share in goal.items():
                have = sum(w * _product(factor, c) for w, c in zip(weight, combos, strict=True) if c[k] == value)
                if have > 0:
                    off = max(off, abs(share / have - 1) if share else 1.0 * (factor[k][value] > 0))
                    factor[k][value] *= share / have
        before, joint = joint, [_product(factor, c) for c in combos]
        if off < close and max((r.moved for r in got), default=0.0) < close and before is not joint:
            break
    table = F.array(*[F.lit(f) for f in joint])
    sized = own.select(first, scale(joint).alias("_a"))
    return rows.join(sized, first).withColumn("factor", F.col("_a") * F.get(table, F.col("_at").cast("int"))).select(*cells.columns, "factor")


def _product(factors: list[dict], combination: tuple) -> float:
    out = 1.0
    for f, value in zip(factors, combination, strict=True):
        out *= f[value]
    return out


def scale_to(factors: DataFrame, tokens: float, repeat: bool = False) -> float:
    """The number a for which ``tokens`` are expected of cells (n, factor) taken min(1, a * factor) times, or a * factor times with ``repeat``.

    If all cells together have fewer tokens, all that have a factor are taken.
    """
    a, before = 0.0, -1
    while True:
        # cells taken whole; each step of Newton's method adds some, up to the root
        whole = F.col("factor") * F.lit(a) >= 1 if not repeat else F.lit(False)
        r = factors.where("factor > 0").agg(F.count(F.when(whole, 1)).alias("k"), F.sum(F.when(whole, F.col("n"))).alias("n"), F.sum(F.when(~whole, F.col("n") * F.col("factor"))).alias("rest")).first()
        if r.k == before or not r.rest:
            return a
        a, before = (tokens - (r.n or 0)) / r.rest, r.k


def sampled(
    docs: DataFrame, columns: dict[str, Column], targets: dict[str, dict] | None = None, temper: float = 0.7, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, repeat: bool = False,
) -> DataFrame:
    """Every row of ``docs`` inside ``row``, its value of each of ``columns``, tokens, factor, probability, selected, copies.

    The first of ``columns`` may have any number of values. ``budget`` is the share of all tokens to take;
    ``copies`` is how often to take the row, more than once only with ``repeat``.
    """
    names = list(columns)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()],
        token_count(text).alias("tokens"),
        F.conv(F.substring(F.md5(F.concat_ws("\x1f", docs[id_col].cast("string"), F.lit(str(seed)), text).cast("binary")), 1, 13), 16, 10).cast("double").alias("_draw"),
    )
    cells = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("n")), "cells")
    factors = cut(raked(cells, names[0], names[1:], targets, temper), "factors")
    if budget is None:
        scale = 1.0 / (factors.agg(F.max("factor")).first()[0] or 1.0)
    else:
        scale = scale_to(factors, budget * (factors.agg(F.sum("n")).first()[0] or 0), repeat)
    joined = rows.join(factors.drop("n"), names)
    wanted = F.col("factor") * F.lit(scale)
    if not repeat:
        wanted = F.least(wanted, F.lit(1.0))
    copies = (F.floor(wanted) + (F.col("_draw") / F.lit(float(16**13)) < wanted - F.floor(wanted)).cast("long")).alias("copies")
    return joined.select("row", *names, "tokens", "factor", F.least(wanted, F.lit(1.0)).alias("probability"), (copies > 0).alias("selected"), copies)
