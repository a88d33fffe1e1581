"""Mixing sources to target weights by Poisson replication.

Each document draws a number of copies from a Poisson distribution whose mean is its source's repetition
rate: a uniform number is made from a hash of seed and document id and put through the inverse distribution,
cut off at the source's cap. The mixture is then put into a global random order.

The mean is first set so that the expected cut-off count is the rate the target share asks for. As the
draws of all documents are fixed by the hash, the tokens a mean yields can be computed beforehand; one
aggregation evaluates a grid of means around the nominal one and the best of each source is taken, which
removes most of the noise that few and very long documents bring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import hash_uniform, stored

#: Most sources; their weights and rates are handled on the driver.
MOST_SOURCES = 10_000
#: Part of a source's cap that its rate may reach; the rest leaves room for the cut-off distribution.
HEADROOM = 0.9
#: Means tried on either side of the nominal one, and their farthest relative distance.
GRID, GRID_WIDTH = 16, 0.4


@dataclass(frozen=True)
class Plan:
    source: str
    target_share: float
    max_repeats: int
    documents: int
    tokens: int
    rate: float
    mean: float
    unfitted_tokens: int = 0  #: what the draws yield with the mean of the target rate, before it is settled


def _cdf(mean: float, k: int) -> float:
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return total


def _expected(mean: float, cap: int) -> float:
    return sum(1 - _cdf(mean, k) for k in range(cap))


def mean_for(rate: float, cap: int) -> float:
    """The Poisson mean whose count, cut off at ``cap``, is expected to be ``rate`` (< cap)."""
    low, high = 0.0, 1.0
    while _expected(high, cap) < rate and high < 500:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _expected(mid, cap) < rate else (low, mid)
    return high


def _steps(mean: float, cap: int) -> list[float]:
    """P(X<=0) .. P(X<=cap-1): a uniform number stands for as many copies as it exceeds of them."""
    return [_cdf(mean, k) for k in range(cap)]


def _table(of: dict[str, Column]) -> Column:
    return F.create_map(*[x for s, c in sorted(of.items()) for x in (F.lit(s), c)])


def _copies(u: Column, steps: Column) -> Column:
    """The inverse distribution on the column ``steps``; no copies where it is null."""
    return F.coalesce(F.size(F.filter(steps, lambda t: t < u)), F.lit(0))


def plan_mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, doc: str, source: str, size: str) -> list[Plan]:
    """Rates and means per source, from two aggregations over all documents."""
    wanted = targets.where("source IS NOT NULL AND target_share > 0").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums = sized.where(F.col(source).isin(*[r["source"] for r in wanted])).groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("t")).collect() if wanted else []
    have = {r[source]: (r["n"], r["t"] or 0) for r in sums}
    caps = {r["source"]: max(0, int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in wanted}
    usable = {r["source"]: float(r["target_share"]) for r in wanted if have.get(r["source"], (0, 0))[1] > 0 and caps[r["source"]] > 0}
    scale = sum(usable.values())
    limit = min((HEADROOM * caps[s] * have[s][1] / (share / scale) for s, share in usable.items()), default=0.0)
    total = min(limit, float(total_tokens) if total_tokens is not None else float(sum(have[s][1] for s in usable)))
    plans = []
    for r in wanted:
        s = r["source"]
        n, t = have.get(s, (0, 0))
        rate = usable[s] / scale * total / t if s in usable else 0.0
        plans.append(Plan(s, float(r["target_share"]), caps[s], n, t, rate, mean_for(rate, caps[s]) if rate > 0 else 0.0))
    return _settled(sized, plans, seed, doc, source, size)


def _settled(sized: DataFrame, plans: list[Plan], seed: int, doc: str, source: str, size: str) -> list[Plan]:
    live = [p for p in plans if p.mean > 0]
    if not live:
        return plans
    grid = [1 + GRID_WIDTH * j / GRID for j in range(-GRID, GRID + 1)]
    tried = _table({p.source: F.array(*[F.array(*map(F.lit, _steps(p.mean * g, p.max_repeats))) for g in grid]) for p in live})
    rows = sized.select(source, size, hash_uniform(doc, seed=seed).alias("_u"), F.try_element_at(tried, F.col(source)).alias("_t")).where("_t IS NOT NULL")
    rows = rows.select(source, size, "_u", F.posexplode("_t").alias("_j", "_steps"))
    sums = rows.groupBy(source, "_j").agg(F.sum(_copies(F.col("_u"), F.col("_steps")) * F.col(size)).alias("_got")).collect()
    got = {(r[source], r["_j"]): r["_got"] or 0 for r in sums}
    out = []
    for p in plans:
        if p.mean > 0:
            aim = p.rate * p.tokens
            best = min(range(len(grid)), key=lambda j: (abs(got.get((p.source, j), 0) - aim), abs(j - GRID)))
            p = replace(p, mean=p.mean * grid[best], unfitted_tokens=int(got.get((p.source, GRID), 0)))
        out.append(p)
    return out


def mixture(documents: DataFrame, targets: DataFrame, size: str, doc: str = "doc_id", source: str = "source", total_tokens: int | None = None, seed: int = 11, plans: list[Plan] | None = None) -> DataFrame:
    """The mixed documents: all columns of ``documents`` with ``copy`` (1..max_repeats) and ``place`` (random global order).

    ``targets`` has ``source, target_share, max_repeats`` (a null cap is 1). ``total_tokens`` defaults to the tokens of the named
    sources, lowered as far as it takes for every source that has documents to reach its share within its cap; sources
    without tokens get nothing and the other shares keep their proportions. Documents of other or null sources, and those with a null id, are left
    out. Empty texts are drawn like others. A repeated id draws the same count each time. An existing column named copy or place is replaced.
    Empty inputs give an empty result.

    Copies are made where the document is read; the only shuffle is the range partitioning by ``place``.
    """
    plans = plan_mixture(documents, targets, total_tokens, seed, doc, source, size) if plans is None else plans
    kept = [c for c in documents.columns if c not in ("copy", "place")]
    live = {p.source: F.array(*map(F.lit, _steps(p.mean, p.max_repeats))) for p in plans if p.mean > 0}
    steps = F.try_element_at(_table(live), F.col(source)) if live else F.lit(None).cast("array<double>")
    count = _copies(hash_uniform(doc, seed=seed), steps)
    copies = documents.where(F.col(doc).isNotNull()).select(*[F.col(f"`{c}`") for c in kept], count.alias("_n")).where("_n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    return copies.withColumn("place", F.xxhash64(F.lit(seed + 1), doc, "copy")).repartitionByRange(F.col("place")).sortWithinPartitions("place")


def mixture_report(mixed: DataFrame, targets: DataFrame, size: str, doc: str = "doc_id", source: str = "source", plans: list[Plan] | None = None) -> DataFrame:
    """Per source of ``targets``: the target and the reached share of all tokens, tokens, texts, and most uses of one text.

    With ``plans`` (see :func:`plan_mixture`) also ``unfitted_share``: what the same draws give with the mean of the target rate itself, before the
    means are settled; null without. Nothing is collected.
    """
    sums = mixed.groupBy(source).agg(F.sum(size).alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(doc).alias("n_documents"), F.max("copy").alias("most_uses"))
    total = sums.agg(F.sum("n_tokens").alias("_total")).withColumn("_one", F.lit(1))
    unfitted = {p.source: p.unfitted_tokens for p in plans or []}
    whole = sum(unfitted.values())
    given = F.try_element_at(_table({k: F.lit(float(v) / whole) for k, v in unfitted.items()}), F.col("source")) if whole else F.lit(None).cast("double")
    rows = targets.where("source IS NOT NULL").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").join(sums.withColumnRenamed(source, "source"), "source", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return rows.select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.when(F.col("_total") > 0, F.col("_total")), F.lit(0.0)).alias("actual_share"), given.alias("unfitted_share"),
        zero("n_tokens", "bigint"), zero("n_rows", "bigint"), zero("n_documents", "bigint"), zero("most_uses", "int"), "max_repeats",
    )


def source_names(targets: DataFrame) -> list[str]:
    """The sources to mix, at most ``MOST_SOURCES``; more are refused."""
    names = [r["source"] for r in targets.where("source IS NOT NULL").select("source").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return names


def sized_documents(documents: DataFrame, size: Column, name: str) -> DataFrame:
    """``documents`` with their sizes, stored once as a table so that texts are tokenised a single time."""
    return stored(documents.withColumn(name, size))
