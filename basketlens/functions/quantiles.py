"""Exact, linearly interpolated quantiles without a single-task value map.

Spark's exact ``percentile`` keeps a value -> count map per group, and for a
global quantile every partial map is merged in one task, so the task holds
every distinct value of the column.  That does not survive a column with a
billion distinct values.

Here the exact answer is found in distributed passes:

1. Per group: count, min and max.  The bracket of every target rank
   ``h = (n - 1) p`` is the whole range.
2. While a bracket holds more than ``bound`` rows between its ends, one pass
   counts the rows below and inside every bracket exactly and takes a grid of
   ``percentile_approx`` points inside it; the bracket shrinks to the grid cells
   around its rank, a fixed part of its rows.  What reaches the driver is one
   row per group.
3. Each value is tagged with the brackets it falls in (or as "below" a
   bracket) and counted per distinct value, map-side.  At most ``bound`` values
   and the two ends are left per bracket, whatever the size and skew of the
   column: a value held by a third of all rows is a single (value, count) row.
4. A running count inside each (group, bracket) locates the values at ranks
   ``floor(h)`` and ``floor(h) + 1``, and the result is interpolated linearly
   (the definition used by NumPy's default method and by SQL ``quantile_cont``).

The grid is coarse against the sketch's rank error of ``1 / accuracy`` of the
rows inside (a cell is at least four errors wide), and a bracket keeps a cell on
either side of its rank.  If one misses its rank all the same, or gets no
smaller, the bracket before is taken again with a finer sketch.  A final check
makes the query fail rather than return a wrong value.

Without a bound on the number of groups the brackets stay in the plan, taken
from one sketch per group with a margin of three errors; groups of up to
``10 * accuracy`` values have their whole range as the bracket.

The sketch works on doubles.  Values are therefore compared with bracket edges
as doubles too: the conversion never reorders values, so a tied value falls
into the bracket with all its ties, and decimals or longs beyond 2^53 are ranked
exactly inside it.

Interpolation is exact: integral and decimal inputs are interpolated in
decimal arithmetic with the probability as an exact fraction; doubles use
``lo + (hi - lo) * frac``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows between a bracket's ends below which it is not narrowed further.
BOUND = 100_000
MOST_PASSES = 60
#: The sketch accuracy at which a bracket that cannot be narrowed consists of ties.
FINE = 40_000


def _narrowed(clean: DataFrame, by: list[str], fracs: list[Fraction], accuracy: int, bound: int,
              max_groups: int | None) -> DataFrame:
    """Brackets with at most ``bound`` rows between their ends, as a table of
    one row per group (groups: at most ``max_groups``)."""
    spark = clean.sparkSession
    lazy = clean.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                  F.min("_d").alias("_dlo"), F.max("_d").alias("_dhi"))
    groups = lazy.limit((max_groups or 1) + 1).collect()
    if len(groups) > (max_groups or 1):
        raise ValueError("exact_quantiles: more groups than max_groups")
    key_type = T.StructType([clean.schema[c] for c in by])
    state = []  # per group: key, n, min, max, and per probability [L, U, rank, rest, done, L and U before]
    for g in groups:
        ranks = [divmod((g["_n"] - 1) * f.numerator, f.denominator) if g["_n"] else (0, 0) for f in fracs]
        state.append([tuple(g[c] for c in by), g["_n"], g["_min"], g["_max"],
                      [[g["_dlo"], g["_dhi"], r, m, g["_n"] <= bound, None] for r, m in ranks]])

    ks = range(len(fracs))
    for _ in range(MOST_PASSES):
        if all(b[4] for s in state for b in s[4]):
            break
        grid = max(4, min(256, accuracy // 4))
        points, coarse = [i / grid for i in range(grid + 1)], False
        edges = spark.createDataFrame(
            [(*s[0], *[x for b in s[4] for x in b[:2]]) for s in state if not all(b[4] for b in s[4])],
            T.StructType([*key_type.fields, *[T.StructField(f"_{e}{k}", T.DoubleType()) for k in ks for e in "LU"]]))
        joined = clean.join(F.broadcast(edges), by) if by else clean.crossJoin(F.broadcast(edges))
        d, aggs = F.col("_d"), []
        for k in ks:
            low, high = F.col(f"_L{k}"), F.col(f"_U{k}")
            aggs += [F.count_if(d < low).alias(f"_below{k}"), F.count_if((d >= low) & (d <= high)).alias(f"_in{k}"),
                     F.count_if((d > low) & (d < high)).alias(f"_mid{k}"),
                     F.percentile_approx(F.when((d >= low) & (d <= high), d), points, accuracy).alias(f"_g{k}")]
        seen = {tuple(r[c] for c in by): r for r in joined.groupBy(*by).agg(*aggs).collect()}
        for key, _, _, _, brackets in state:
            for k, b in enumerate(brackets):
                if b[4]:
                    continue
                r = seen[key]
                below, inside, rank = r[f"_below{k}"], r[f"_in{k}"], b[2]
                if not below <= rank or not rank + (b[3] > 0) < below + inside:
                    b[0], b[1], coarse = *b[5], True  # missed: the bracket before holds the rank
                    continue
                if r[f"_mid{k}"] <= bound:
                    b[4] = True
                    continue
                first = (rank - below) * grid // inside - 1
                last = -(-(rank + 2 - below) * grid // inside) + 1
                low = r[f"_g{k}"][first] if first > 0 else b[0]
                high = r[f"_g{k}"][last] if last < grid else b[1]
                stays = (low, high) == (b[0], b[1])
                b[4], b[5] = stays and accuracy >= FINE, (b[0], b[1])
                b[0], b[1], coarse = low, high, coarse or stays
        accuracy = min(FINE, 4 * accuracy) if coarse else accuracy
    fields = [*key_type.fields, lazy.schema["_min"], lazy.schema["_max"]]
    for k in ks:
        fields += [T.StructField(f"_L{k}", T.DoubleType()), T.StructField(f"_U{k}", T.DoubleType()),
                   T.StructField(f"_r{k}", T.LongType()), T.StructField(f"_m{k}", T.LongType())]
    return spark.createDataFrame([(*key, low, high, *[x for b in brackets for x in b[:4]])
                                  for key, _, low, high, brackets in state], T.StructType(fields))


def _running(counted: DataFrame, by: list[str]) -> DataFrame:
    """Ranks of the counted values of each bracket: from ``_start`` up to
    before ``_end``.  A bracket is a task; its rows are bounded."""
    w = (Window.partitionBy(*by, "_j").orderBy(F.col("_x").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))


def _sketched(clean: DataFrame, by: list[str], inner: list[tuple[int, float]], fracs: list[Fraction],
              accuracy: int) -> DataFrame:
    """Brackets of any number of groups, lazily, from one sketch per group."""
    margin = 3.0 / accuracy
    stats = clean.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_d", [max(0.0, p - margin) for _, p in inner], accuracy).alias("_alo"),
        F.percentile_approx("_d", [min(1.0, p + margin) for _, p in inner], accuracy).alias("_ahi"))
    small = F.col("_n") <= F.lit(10 * accuracy)
    cols = []
    for k, fr in enumerate(fracs):
        t = (F.col("_n") - 1) * F.lit(fr.numerator)
        cols += [
            F.when(small, F.col("_min").cast("double")).otherwise(F.col("_alo")[k]).alias(f"_L{k}"),
            F.when(small, F.col("_max").cast("double")).otherwise(F.col("_ahi")[k]).alias(f"_U{k}"),
            F.floor(t / F.lit(fr.denominator)).cast("long").alias(f"_r{k}"),
            F.pmod(t, F.lit(fr.denominator)).cast("long").alias(f"_m{k}"),
        ]
    return stats.select(*by, "_min", "_max", *cols)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], names: list[str],
                    by: list[str] | tuple[str, ...] = (), accuracy: int = 10_000,
                    max_groups: int | None = None, bound: int = BOUND) -> DataFrame:
    """One row per group of ``by`` with one column per probability.

    NULL values are ignored.  Output columns for interior probabilities are
    decimal for integral/decimal input and double for floating input;
    probabilities 0 and 1 return min and max in the input type.

    ``max_groups``: a bound on the number of groups the caller can prove
    (e.g. a fixed label set).  With it, and without groups, the brackets are
    narrowed in jobs of their own (at call time) and broadcast to the rows, and
    ``ValueError`` is raised if there are more groups; without it they are
    joined by a shuffle on the group key, where AQE splits a skewed group.

    ``bound``: the rows that a bracket may hold between its ends.

    A probability has to be a fraction with a denominator of 1,000,000 at most.
    """
    if len(probs) != len(names):
        raise ValueError("probs and names differ in length")
    for p in probs:
        if not 0 <= p <= 1 or abs(float(Fraction(p).limit_denominator(1_000_000)) - p) > 1e-15:
            raise ValueError(f"probability {p} is not a fraction with a denominator up to 1,000,000")
    by = list(by)
    dtype = df.schema[value].dataType
    clean = (df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
             .withColumn("_d", F.col("_v").cast("double")))

    inner = [(j, p) for j, p in enumerate(probs) if 0.0 < p < 1.0]
    edge = {0.0: "_min", 1.0: "_max"}
    if not inner:
        stats = clean.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        return stats.select(*by, *[F.col(edge[p]).alias(n) for p, n in zip(probs, names)])

    fracs = [Fraction(p).limit_denominator(1_000_000) for _, p in inner]
    if not by or max_groups is not None:
        # One row per group and a checked group bound: broadcast, so a hot
        # group is never shuffled into a single task.
        brackets = F.broadcast(_narrowed(clean, by, fracs, accuracy, bound, max_groups))
        joined = clean.join(brackets, by) if by else clean.crossJoin(brackets)
    else:
        joined = clean.join(_sketched(clean, by, inner, fracs, accuracy), by)

    v, d = F.col("_v"), F.col("_d")
    tags = F.array(*[
        F.when(d <= F.col(f"_U{k}"),
               F.struct(F.lit(k).alias("j"),
                        F.when(d >= F.col(f"_L{k}"), v).alias("x"),
                        F.col(f"_r{k}").alias("r"),
                        F.col(f"_m{k}").alias("m")))
        for k in range(len(inner))
    ])
    consts = ["_min", "_max"]
    tagged = (joined
              .select(*by, *consts, F.explode(F.filter(tags, lambda s: s.isNotNull())).alias("_t"))
              .select(*by, *consts, F.col("_t.j").alias("_j"), F.col("_t.x").alias("_x"),
                      F.col("_t.r").alias("_r"), F.col("_t.m").alias("_m")))
    # Map-side partial counts per distinct value.  Each bracket is then a task
    # of its own; what is left in it is bounded by the bracket's size.
    counted = tagged.groupBy(*by, *consts, "_j", "_r", "_m", "_x").agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.repartition(*by, "_j")

    located = _running(counted, by)

    def at_rank(rank):
        hit = F.col("_x").isNotNull() & (F.col("_start") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(hit, F.col("_x")))

    picked = located.groupBy(*by, *consts, "_j", "_r", "_m").agg(
        at_rank(F.col("_r")).alias("_xlo"), at_rank(F.col("_r") + 1).alias("_xhi"))

    denom = F.coalesce(*[F.when(F.col("_j") == k, F.lit(fr.denominator))
                         for k, fr in enumerate(fracs)])
    xlo, xhi, m = F.col("_xlo"), F.col("_xhi"), F.col("_m")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        lo_v, hi_v = xlo.cast("double"), xhi.cast("double")
        interp = lo_v + (hi_v - lo_v) * (m.cast("double") / denom.cast("double"))
    else:
        if isinstance(dtype, T.DecimalType):
            lo_v, hi_v = xlo, xhi
        else:
            lo_v, hi_v = xlo.cast("decimal(20,0)"), xhi.cast("decimal(20,0)")
        interp = lo_v + (hi_v - lo_v) * m.cast("decimal(20,0)") / denom.cast("decimal(20,0)")
    missed = xlo.isNull() | ((m != 0) & xhi.isNull())
    q = (F.when(missed, F.raise_error(F.lit("exact_quantiles: rank outside its bracket")))
         .when(m == 0, lo_v).otherwise(interp))
    wide = picked.select(*by, *consts, "_j", q.alias("_q")).groupBy(*by).agg(
        F.max("_min").alias("_min"), F.max("_max").alias("_max"),
        *[F.max(F.when(F.col("_j") == k, F.col("_q"))).alias(f"_q{k}") for k in range(len(inner))])

    out, k = [], 0
    for p, n in zip(probs, names):
        if p in edge:
            out.append(F.col(edge[p]).alias(n))
        else:
            out.append(F.col(f"_q{k}").alias(n))
            k += 1
    return wide.select(*by, *out)
