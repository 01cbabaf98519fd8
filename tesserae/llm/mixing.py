"""Mixing sources to target weights.

Temperature mixing between the targets and the present shares: the weight of a source is
``target ** (1 - a) * natural ** a``, normalised; at exponent 0 the targets, at 1 the present shares. The
budgets at exponent 0 show which sources cannot reach their target: they are cut to what their
documents give when used as often as they may, and held there. What they leave is shared among the
others by one exponent, bisected to the least at which none of them is repeated more often than it
may: normally 0, so that they keep their targets' proportions. Without targets, natural shares are exponentiated by one exponent, bisected
until they meet a target entropy.

The normalised weights are realised as budgeted block permutations: whole passes over a source and a
part of one more, each pass in its own pseudo-random order; the part is cut by running sums over hash
ranges, so no source is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.llm.tokens import TOKENIZER_DIR, encoding
from tesserae.plans.runtime import broadcast_within, cut, spread

#: Hash ranges in which the tokens of a pass are summed.
RANGES = 4096
#: Sources that one plan may weigh: their sums are brought to the driver.
MOST_SOURCES = 1_000_000


def sized(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizers: str = TOKENIZER_DIR) -> DataFrame:
    """``id``, ``source``, ``tokens`` of the rows with a source; a null text has 0 tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizers).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(counts, pa.int64())], names=["id", "source", "tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("source is not null")
    return spread(rows).mapInArrow(measure, f"id {kind}, source string, tokens bigint")


def entropy(weights: list[float]) -> float:
    """Shannon entropy in nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Normalised ``target * (natural / target) ** exponent``; a share of 0 stays 0."""
    raw = [t * (n / t) ** exponent if n > 0 and t > 0 else 0.0 for n, t in zip(natural, target)]
    return [r / sum(raw) for r in raw] if sum(raw) > 0 else raw


def bisect_exponent(fits, low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The least exponent in the range that fits, or ``high``; ``fits`` holds from some point on."""
    if fits(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def exponent_for_entropy(natural: list[float], wanted: float) -> float:
    """The exponent at which the natural shares, exponentiated and normalised, have the wanted entropy (lower exponents are flatter)."""
    even = [1.0 if n > 0 else 0.0 for n in natural]
    return bisect_exponent(lambda a: entropy(tempered(natural, even, a)) <= wanted, 0.0, 8.0)


def plan_weights(tokens: dict[str, int], targets: dict[str, tuple[float, int | None]], target_entropy: float | None = None, total: int | None = None) -> list[tuple]:
    """(source, tokens, target, max repeats, capacity, reachable, exponent, weight, budget) of each source with documents or a target.

    ``total`` is the size of the mix, by default the present token count of all sources. A source is
    reachable if its budget at exponent 0 is not cut by its capacity, ``tokens * max_repeats``; a null
    limit is none, a null share is 0. Weights sum to 1, and budgets to the total unless every source is at its limit.
    """
    names = sorted({*tokens, *targets})
    total = sum(tokens.values()) if total is None else total
    have = [tokens.get(s, 0) for s in names]
    goal = [max(0.0, targets.get(s, (0.0, None))[0] or 0.0) for s in names]
    limit = [targets.get(s, (0.0, None))[1] for s in names]
    capacity = [math.inf if r is None and h else h * (r or 0) for h, r in zip(have, limit)]
    natural = [h / total if total else 0.0 for h in have]
    at_target = [min(g * total, c) for g, c in zip(goal, capacity)]
    reachable = [b == g * total for b, g in zip(at_target, goal)]
    exponents, budget = [0.0] * len(names), at_target
    if target_entropy is not None:
        exponents = [exponent_for_entropy(natural, target_entropy)] * len(names)
        budget = [min(w * total, c) for w, c in zip(tempered(natural, [1.0] * len(names), exponents[0]), capacity)]
    else:
        held = [not ok for ok in reachable]
        while not all(held):
            free = [i for i, h in enumerate(held) if not h]
            rest = total - sum(c for c, h in zip(capacity, held) if h)
            shares = lambda a, free=free: tempered([natural[i] for i in free], [goal[i] for i in free], a)
            over = lambda a, free=free, rest=rest, shares=shares: [i for i, w in zip(free, shares(a)) if w * rest > capacity[i] * (1 + 1e-12)]
            a = bisect_exponent(lambda a, over=over: not over(a))
            for i, w in zip(free, shares(a)):
                exponents[i], budget[i] = a, min(w * rest, capacity[i])
            beyond = over(a)
            if not beyond:
                break
            for i in beyond:  # even in their present shares these would be repeated too often
                held[i] = True
    size = sum(budget)
    weights = [b / size if size else 0.0 for b in budget]
    return [(s, h, g, r, None if math.isinf(c) else int(c), ok, a, w, int(b)) for s, h, g, r, c, ok, a, w, b in zip(names, have, goal, limit, capacity, reachable, exponents, weights, budget)]


_PLAN = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("target_share", T.DoubleType()),
    T.StructField("max_repeats", T.IntegerType()), T.StructField("capacity", T.LongType()), T.StructField("reachable", T.BooleanType()),
    T.StructField("exponent", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("budget", T.LongType()),
])


def plan(sizes: DataFrame, targets: DataFrame, target_entropy: float | None = None) -> DataFrame:
    """The weights of :func:`plan_weights` for sized documents; one row for each source.

    Only sums reach the driver: of the sources with a target, or with a target entropy of all. Others
    have weight 0. Repeated rows of a target: the largest share and limit count. Without documents, no
    source with a share above 0 is reachable.
    """
    sums = cut(sizes.groupBy("source").agg(F.sum("tokens").alias("n")))
    facts = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("sources")).first()
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    if facts["sources"] > MOST_SOURCES and target_entropy is not None or wanted.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to weigh; group them first")
    rows = wanted.join(sums, "source", "left" if target_entropy is None else "full").collect()
    tokens = {r["source"]: r["n"] for r in rows if r["n"] is not None}
    made = plan_weights(tokens, {r["source"]: (r["share"], r["repeats"]) for r in rows if r["share"] is not None or r["repeats"] is not None}, target_entropy, facts["total"])
    if not facts["total"]:
        made = [(*m[:5], m[2] <= 0, *m[6:]) for m in made]
    planned = sizes.sparkSession.createDataFrame(made, _PLAN)
    if target_entropy is not None:
        return planned
    none = lambda kind: F.lit(None).cast(kind)
    others = sums.join(wanted, "source", "left_anti").select("source", F.col("n").alias("tokens"), F.lit(0.0), none("int"), none("bigint"), F.lit(True), F.lit(0.0), F.lit(0.0), F.lit(0).cast("bigint"))
    return planned.union(others)


def mix(sizes: DataFrame, weights: DataFrame, seed: int = 11) -> DataFrame:
    """``id``, ``source``, ``tokens``, ``pass_no``, ``place``, ``position``: the mixed records, to be read in the order of position.

    A position is how much of its source's budget is used up before the record, from 0 to about 1: every
    stretch of positions holds the sources in their shares, and of each source one permutation of its documents after the other.

    A document of a repeated row is one record for each row. Whole passes use every document once; of
    the last one, the documents first in its order whose running sum is within the rest of the budget.
    A document is used at most ``max_repeats`` times.
    """
    passes = weights.filter("budget > 0 and tokens > 0").select("source", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), (F.col("budget") / F.col("tokens")).alias("passes"))
    used = sizes.join(broadcast_within(passes, weights.filter("budget > 0").count(), 128), "source").withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("whole") + (F.col("rest") > 0).cast("int"))))
    used = used.withColumn("place", F.xxhash64(F.lit(seed), "source", "pass_no", "id"))
    whole = used.filter("pass_no <= whole")
    part = used.filter("pass_no > whole").withColumn("range", F.shiftrightunsigned("place", 64 - int(math.log2(RANGES))))
    by_range = part.groupBy("source", "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    running = by_range.withColumn("until", F.sum("n").over(Window.partitionBy("source").orderBy("range")))
    edge = running.select("source", "range", (F.col("until") - F.col("n")).alias("before"), (F.col("until") <= F.col("rest")).alias("all"))
    placed = part.join(edge, ["source", "range"])  # as many rows as sources that are cut within a pass, times RANGES
    full = placed.filter("all")
    cut_range = placed.filter("not all and before < rest").withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("place", "id")))
    within = F.shiftrightunsigned("place", 11) / F.lit(float(1 << 53))
    columns = ["id", "source", "tokens", "pass_no", "place", ((F.col("pass_no") - 1 + within) / F.col("passes")).alias("position")]
    return whole.select(columns).unionByName(full.select(columns)).unionByName(cut_range.filter("sum <= rest").select(columns))


def report(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target, planned and reached shares by source, with the most uses of one document's source."""
    reached = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("pass_no").alias("passes"))
    joined = weights.join(reached, "source", "left").fillna({"mixed_tokens": 0, "passes": 0})
    joined = joined.crossJoin(F.broadcast(reached.agg(F.sum("mixed_tokens").alias("all_tokens"))))  # one row
    return joined.select("source", "tokens", "target_share", "max_repeats", "capacity", "reachable", "exponent", "weight", "mixed_tokens", "passes", F.col("budget").alias("planned_tokens"), (F.col("mixed_tokens") / F.nullif("all_tokens", F.lit(0))).alias("reached_share"))


def mixed_documents(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mixed records and the report of a documents table."""
    sizes = cut(sized(documents))
    weights = plan(sizes, targets)
    mixed = mix(sizes, weights)
    return mixed, report(mixed, weights)


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``: sources that fall short of their target although the mix uses every document of theirs as often as it may.

    Read from the realised mix: a source is short if its mixed tokens are all that its documents may give
    and less than its share of the present token count.
    """
    reached = mixed_documents(documents, targets)[1]
    total = reached.agg(F.sum("tokens").alias("total"))
    short = (F.col("mixed_tokens") == F.col("capacity")) & (F.col("mixed_tokens") < F.col("target_share") * F.col("total"))
    none = (F.col("total") == 0) & (F.col("target_share") > 0)  # without documents nothing is reached
    return reached.crossJoin(F.broadcast(total)).filter(short | none).select("source")
