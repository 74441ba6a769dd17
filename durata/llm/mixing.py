"""Mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised: 1 keeps the
natural mix, 0 makes it uniform.  The exponent is bisected to the target; the
weights then become whole draws of documents under a token budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small, stored, unused

WORD = r"[^\x20\x09-\x0D]+"
_POINTS, _ROUNDS = 17, 8  # each round narrows the bracket to a sixteenth


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _bisect(shares: DataFrame, good: Column, low: float, high: float) -> float:
    """The least exponent of [low, high] at which ``good``, once true, stays true; ``high`` if none.

    ``good`` is an aggregate over ``p`` (a source's share) with ``{a}`` in its SQL
    text; all points of a round are columns of one aggregate, so a round is one
    small job whatever the number of sources.
    """
    for _ in range(_ROUNDS):
        points = [low + (high - low) * k / (_POINTS - 1) for k in range(_POINTS)]
        row = shares.agg(*[F.expr(good.format(a=repr(a))).alias(f"g{k}") for k, a in enumerate(points)]).first()
        hit = next((k for k in range(_POINTS) if row[k]), _POINTS - 1)
        if hit == 0:
            return points[0]
        low, high = points[hit - 1], points[hit]
    return high


def find_exponent(sources: DataFrame, budget: int, total: int, target_entropy: float | None, max_repetition: float | None) -> float:
    """The exponent whose mix has at most ``target_entropy`` nats and repeats no source above ``max_repetition``.

    Entropy falls as the exponent grows; so does the repetition of the source
    that is repeated most, ``budget * w / tokens``, for exponents up to 1.  The
    larger of both solutions meets both, as far as the natural mix (1) does.
    Without a target the exponent is 1.
    """
    shares = sources.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    found = []
    if target_entropy is not None:
        entropy = "ln(sum(pow(p, {a}))) - {a} * sum(pow(p, {a}) * ln(p)) / sum(pow(p, {a}))"
        found.append(_bisect(shares, f"({entropy}) <= {target_entropy!r}", 0.0, 8.0))
    if max_repetition is not None:
        found.append(_bisect(shares, f"{budget / total!r} * max(pow(p, {{a}} - 1)) / sum(pow(p, {{a}})) <= {max_repetition!r}", 0.0, 1.0))
    return max(found, default=1.0)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget_share: float = 1.0,
    entropy_share: float | None = 0.97,
    max_repetition: float | None = 4.0,
    block_rows: int = 4096,
    seed: int = 1,
) -> DataFrame:
    """``df`` with ``_source_tokens, _weight, _draws`` added: how often each row is drawn.

    The budget is ``budget_share`` of all words.  ``entropy_share`` is the target
    entropy as a share of the greatest possible one, ``ln(sources)``.  A source
    with weight w gets ``w * budget`` words: whole passes over its rows, then one
    part of a pass that never exceeds what is left.  That part follows a
    permutation of the source's hash blocks (about ``block_rows`` rows each) and,
    in the one block where the budget ends, of its rows.  Whole blocks need no
    order of their rows, so a source with a third of all rows is no hot task.

    A null source is a source of its own.  Rows without words cost nothing and
    are drawn with each whole pass, and once if there is none (weight 0 included),
    so that a filtering pipeline loses no row to an empty text.  Ties of the order
    are broken by the row's hash; rows that are equal throughout may swap.  An
    empty table stays empty.  Columns of ``df`` pass through untouched; an added
    name that exists already, in whatever case, gets underscores more.
    """
    if budget_share <= 0 or block_rows < 1:
        raise ValueError("budget_share and block_rows must be positive")
    names, place = df.columns, {c.lower(): f"_in{i}" for i, c in enumerate(df.columns)}
    df = df.toDF(*[f"_in{i}" for i in range(len(names))])  # free of clashes below
    id_col, source_col, text_col = (place[c.lower()] for c in (id_col, source_col, text_col))
    rows = df.select("*", word_count(F.col(text_col)).alias("_tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"))
    light = stored(rows.select(source_col, "_tokens", "_h"))  # what counts, without the texts
    sources = stored(light.groupBy(F.col(source_col).alias("_s")).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")))
    total, kinds = sources.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0)).first()
    total, budget = total or 0, int((total or 0) * budget_share)
    a = find_exponent(sources, budget, total, entropy_share and entropy_share * math.log(kinds), max_repetition) if total else 1.0
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))).otherwise(0.0)
    norm = (sources.agg(F.sum(power)).first()[0] or 1.0) if total else 1.0
    quota = sources.select(
        "_s", "tokens", (power / F.lit(norm)).alias("_weight"), F.ceil(F.col("rows") / block_rows).alias("_blocks"),
        F.floor(power / F.lit(norm) * F.lit(float(budget))).cast("long").alias("_quota"),
    )
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("_quota") / F.col("tokens"))).otherwise(1).cast("long")
    quota = quota.select("_s", F.col("tokens").alias("_source_tokens"), "_weight", "_blocks", whole.alias("_whole"), (F.col("_quota") - whole * F.col("tokens")).alias("_left"))
    quota = small(stored(quota))
    deal = lambda some: some.join(quota, some[source_col].eqNullSafe(quota["_s"])).drop("_s").withColumn("_block", F.pmod("_h", F.col("_blocks")))

    key = F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    blocks = deal(light).groupBy(source_col, "_block", "_left").agg(F.sum("_tokens").alias("_n"))
    order = Window.partitionBy(source_col).orderBy(F.xxhash64(F.lit(seed + 1), key, "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    blocks = blocks.select(F.col(source_col).alias("_s"), F.col("_block").alias("_b"), (F.col("_left") - F.col("_before")).alias("_room"), F.col("_n").alias("_block_n"))
    blocks = small(stored(blocks))  # a row a few thousand documents; where they are few, no document moves for them
    dealt = deal(rows)
    at = dealt.join(blocks, dealt[source_col].eqNullSafe(blocks["_s"]) & (dealt["_block"] == blocks["_b"])).drop("_s", "_b")
    cut = (F.col("_room") > 0) & (F.col("_room") < F.col("_block_n"))
    # only the blocks at which a budget ends are put in order; no other row is shuffled
    inside = Window.partitionBy(source_col, "_block").orderBy(F.xxhash64(F.lit(seed + 2), "_h"), "_h").rowsBetween(Window.unboundedPreceding, 0)
    ends = at.filter(cut).withColumn("_used", F.sum("_tokens").over(inside)).withColumn("_extra", (F.col("_used") <= F.col("_room")).cast("long")).drop("_used")
    whole_blocks = at.filter(~F.coalesce(cut, F.lit(False))).withColumn("_extra", (F.col("_room") >= F.col("_block_n")).cast("long"))
    out = ends.unionByName(whole_blocks)
    draws = F.when(F.col("_tokens") == 0, F.greatest(F.col("_whole"), F.lit(1))).otherwise(F.col("_whole") + F.col("_extra")).cast("int")
    values = [F.col("_tokens"), F.col("_source_tokens"), F.col("_weight"), draws]
    return out.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(names)], *[v.alias(c) for v, c in zip(values, added_names(names), strict=True)])


def added_names(columns: list[str]) -> list[str]:
    """What :func:`mix_sources` calls its columns beside these."""
    return [unused(c, columns) for c in ("_tokens", "_source_tokens", "_weight", "_draws")]


def drawn(df: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows themselves, each as often as it is drawn, with the columns of ``df``."""
    draws = F.col(added_names(df.columns)[-1])
    row = F.struct(*df.columns).alias("row")
    return mixed.filter(draws > 0).select(row, F.explode(F.sequence(F.lit(1), draws)).alias("copy")).select("row.*")
