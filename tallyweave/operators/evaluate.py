"""Paired evaluation: scores, savings, quality, confidence intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text

ITERATIONS, ALPHA = 10_000, 0.05
TIE = 1e-9
MARGIN = 0.03


def objective_score(check: Column, output: Column, exit_code: Column | None = None) -> Column:
    """1.0 or 0.0 of a check (type, value, pattern, values), null without one or for an unknown type.

    Tests of code are not run here: their exit code is an input.
    """
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    value = check["value"]
    kind = check["type"]
    out = F.when(kind == "contains", yes(F.contains(output, value))).when(kind == "not_contains", yes(~F.contains(output, value)))
    out = out.when(kind == "regex", yes(F.regexp_like(output, check["pattern"]))).when(kind == "exact", yes(text.stripped(output) == text.stripped(value)))
    out = out.when(kind == "all_of", yes(F.forall(check["values"], lambda v: F.contains(output, v))))
    return out if exit_code is None else out.when(kind == "code_tests", yes(F.coalesce(exit_code == 0, F.lit(False))))


def verdict(raw: Column) -> Column:
    """A, B or tie of a judge's reply: its JSON's winner, else what the text names, else a tie."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    js = (body != "") & F.try_parse_json(body).isNotNull()
    w = F.trim(F.coalesce(F.get_json_object(body, "$.winner"), F.lit("tie")))
    low = F.lower(raw)
    said = lambda x: F.contains(low, F.lit("winner")) & F.contains(low, F.lit(f'"{x}"'))
    return F.when(F.coalesce(js, F.lit(False)), F.when(w.isin("A", "B", "tie"), w).otherwise("tie")).when(said("a"), "A").when(said("b"), "B").otherwise("tie")


def swapped(seed: Column) -> Column:
    """Whether the compressed answer is shown first: a coin for each seed that every engine flips alike."""
    return F.conv(F.substring(F.md5(seed.cast("string")), 32, 1), 16, 10).cast("int") % 2 == 1


def pairwise(raw: Column, swap: Column) -> Column:
    """(baseline, compressed, verdict) of a blind comparison, un-shuffled."""
    v = verdict(raw)
    won = (v == "A") == swap
    return F.when(v == "tie", F.struct(F.lit(0.5).alias("baseline"), F.lit(0.5).alias("compressed"), F.lit("tie").alias("verdict"))).otherwise(F.struct(F.when(won, 0.0).otherwise(1.0).alias("baseline"), F.when(won, 1.0).otherwise(0.0).alias("compressed"), F.when(won, "compressed").otherwise("baseline").alias("verdict")))


#: What a judge is told before the task; ``verdict`` reads the JSON that it asks for.
INSTRUCTION = """Below are a task and two candidate replies, A and B. Decide which reply a careful user would rather have, \
going by correctness and completeness. A longer reply is not better for its length. If neither is ahead, call a tie.
Answer with one JSON object, {"winner": "A", "B" or "tie", "reason": one sentence}, and nothing else."""


def judge_prompt(rubric: Column, baseline: Column, compressed: Column, swap: Column, instruction: str = INSTRUCTION) -> Column:
    """What a judge is asked: two answers without names, the compressed one first if ``swap``."""
    a, b = F.when(swap, compressed).otherwise(baseline), F.when(swap, baseline).otherwise(compressed)
    part = lambda name: F.lit(f"\n\n<{name}>\n")
    return F.concat(F.lit(instruction), part("task"), rubric, part("reply A"), a, part("reply B"), b)


def paired(baseline: DataFrame, compressed: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The two arms of an experiment side by side, and what has no partner.

    Pairs are found by their keys, such as config, task and turn, so neither the order of
    the rows nor a turn that failed in one arm can shift the others.  Columns beside the
    keys come as ``baseline_`` and ``compressed_`` ones.  A key that an arm has several times
    is an error of the experiment: its rows are in the second table too, as are rows with a
    null key.  That table is (keys, arm, n).
    """
    b = baseline.select(*keys, F.struct(*[F.col(c) for c in baseline.columns if c not in keys]).alias("_row"), F.lit("baseline").alias("arm"))
    c = compressed.select(*keys, F.struct(*[F.col(c) for c in compressed.columns if c not in keys]).alias("_row"), F.lit("compressed").alias("arm"))
    once = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"_{name}_n"), F.any_value("_row").alias(f"_{name}"))
    both = once(b, "baseline").join(once(c, "compressed"), list(keys), "full")
    fit = F.coalesce((F.col("_baseline_n") == 1) & (F.col("_compressed_n") == 1), F.lit(False))
    named = lambda df, name: [F.col(f"_{name}")[x].alias(f"{name}_{x}") for x in df.columns if x not in keys]
    pairs = both.where(fit).select(*keys, *named(baseline, "baseline"), *named(compressed, "compressed"))
    sides = F.array(*[F.struct(F.lit(name).alias("arm"), F.col(f"_{name}_n").alias("n")) for name in ("baseline", "compressed")])
    rest = both.where(~fit).select(*keys, F.explode(sides).alias("s")).select(*keys, "s.arm", "s.n").where("n is not null")
    return pairs, rest


def final_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """The scores of the last scored turn of each task (keys, turn, baseline_score, compressed_score)."""
    both = scores.where("baseline_score is not null and compressed_score is not null")
    last = both.groupBy(*keys).agg(F.max_by(F.struct("baseline_score", "compressed_score"), "turn").alias("s"))
    return last.select(*keys, "s.baseline_score", "s.compressed_score")


def overridden(task_check: Column, turn_check: Column) -> Column:
    """A turn's check if it has one, else its task's."""
    return F.coalesce(turn_check, task_check)


def saved_pct(baseline: Column, compressed: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * (baseline - compressed), baseline), F.lit(0.0))


def savings_means(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of paired turns (keys, baseline_input, compressed_input, baseline_cost, compressed_cost).

    The mean of the turns' savings counts a turn of nothing as 0; costs are compared as a
    ratio of means.
    """
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(saved_pct(F.col("baseline_input"), F.col("compressed_input"))).alias("mean_saved_pct"), F.avg("baseline_cost").alias("mean_cost_baseline"), F.avg("compressed_cost").alias("mean_cost_compressed"))
    return g.withColumn("mean_cost_reduction_pct", saved_pct(F.col("mean_cost_baseline"), F.col("mean_cost_compressed")))


def savings_report(pairs: DataFrame, *keys: str, iterations: int = ITERATIONS, alpha: float = ALPHA) -> DataFrame:
    """savings_means with the bootstrap interval of the mean saving, ci_lo to ci_hi, 0 without turns."""
    pct = pairs.select(*keys, saved_pct(F.col("baseline_input"), F.col("compressed_input")).alias("_pct"))
    ci = bootstrap_by(pct, "_pct", *keys, iterations=iterations, alpha=alpha)
    ci = ci.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    out = savings_means(pairs, *keys).join(ci, _same(keys), "left").drop(*(f"_k{i}" for i in range(len(keys))))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ci_lo", "ci_hi")})


def savings_by_turn(pairs: DataFrame, *keys: str) -> DataFrame:
    """The trend over turns; turns of nothing are left out."""
    return pairs.where("baseline_input <> 0").groupBy(*keys, "turn").agg(F.avg(100.0 * (F.col("baseline_input") - F.col("compressed_input")) / F.col("baseline_input")).alias("saved_pct"))


def quality_report(scores: DataFrame, *keys: str) -> DataFrame:
    """Of paired scores (keys, baseline_score, compressed_score), both present."""
    d = F.col("baseline_score") - F.col("compressed_score")
    both = scores.where("baseline_score is not null and compressed_score is not null")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("baseline_score").alias("mean_baseline"), F.avg("compressed_score").alias("mean_compressed"), F.avg(d).alias("mean_loss"), F.count_if(d < -TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d > TIE).alias("losses"))


def bootstrap_ci(values: DataFrame, value: str, iterations: int = ITERATIONS, alpha: float = ALPHA) -> DataFrame:
    """(n, mean, lo, hi): percentile bootstrap of the mean of ``values``.

    Draw k of an iteration is a part of the MD5 of the iteration and k // 4, modulo n, so
    every engine draws alike.  A histogram of at most ``MOST_DISTINCT`` distinct values is
    held in the plan, and the draws are spread over tasks by iteration and summed there;
    with more values they are joined with a table of values by rank.
    """
    h = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")).orderBy("v").limit(MOST_DISTINCT + 1).collect()
    spark = values.sparkSession
    if not h:
        return spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    if len(h) > MOST_DISTINCT:
        return bootstrap_by(values, value, iterations=iterations, alpha=alpha)
    n = sum(r["c"] for r in h)
    ends, at = [], 0
    for r in h:
        at += r["c"]
        ends.append((at, r["v"]))
    draws = spark.range(0, iterations, 1, min(64, iterations)).select(F.col("id").alias("it"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // 4).cast("long"))).alias("four"))
    hashed = draws.select("it", "four", F.md5(F.concat_ws(":", F.col("it").cast("string"), F.col("four").cast("string"))).alias("h"))

    def at(p: Column) -> Column:
        out = None
        for upto, v in ends:
            out = F.when(p < upto, v) if out is None else out.when(p < upto, v)
        return out

    four = sum((F.when(F.col("four") * 4 + k < n, at(draw(F.col("h"), k, n))).otherwise(0.0) for k in range(4)), F.lit(0.0))
    means = hashed.select("it", four.alias("v")).groupBy("it").agg((F.sum("v") / n).alias("m"))
    ranked = means.groupBy().agg(F.array_sort(F.collect_list("m")).alias("m"))
    mean = sum(r["v"] * r["c"] for r in h) / n
    return ranked.select(F.lit(n).cast("long").alias("n"), F.lit(float(mean)).alias("mean"), F.get("m", F.lit(int(alpha / 2 * iterations))).alias("lo"), F.get("m", F.lit(int((1 - alpha / 2) * iterations))).alias("hi"))


#: Distinct values that a bootstrap holds in its plan.
MOST_DISTINCT = 200
#: Ranges of values that are ranked apart, and the longest sequence that a row is exploded to.
RANGES, RUN = 256, 1 << 16


def _same(keys: tuple[str, ...]) -> Column:
    """Whether the columns ``keys`` are those of the other side, _k0, _k1, ...; nulls are equal."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))


def _each(n: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each number from ``first`` to ``last``, without an array of more than RUN or of last / RUN."""
    runs = n.withColumn("_last", last).withColumn("_from", F.explode(F.sequence(first, F.col("_last"), F.lit(RUN).cast("long"))))
    return runs.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + RUN - 1, F.col("_last"))))).drop("_last", "_from")


def _ranked(h: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, p, v) of a histogram (keys, v, c): the value of each rank from 0, no range of values in one task."""
    cuts = h.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x <= F.col("v"))) if cuts else F.lit(0)
    h = h.withColumn("part", part)
    so_far = F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("s").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = h.groupBy(*keys, "part").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(before, F.lit(0)))
    start = start.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("part").alias("_part"), "before")
    upto = h.withColumn("upto", so_far).join(start, _same(keys) & (F.col("part") == F.col("_part"))).withColumn("upto", F.col("upto") + F.col("before"))
    return _each(upto, F.col("upto") - F.col("c"), F.col("upto") - 1, "p").select(*keys, "p", "v")


def bootstrap_by(values: DataFrame, value: str, *keys: str, iterations: int = ITERATIONS, alpha: float = ALPHA) -> DataFrame:
    """(keys, n, mean, lo, hi): the interval of bootstrap_ci for each group, of any number of distinct values.

    Every group draws as if it were alone.  Without keys there is one row, of zeros if there
    are no values.
    """
    h = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    groups = h.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).where("n > 0")
    its = values.sparkSession.range(0, iterations, 1, min(64, iterations)).withColumnRenamed("id", "it")
    draws = _each(its.crossJoin(F.broadcast(groups)), F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4), "four")
    draws = draws.withColumn("h", F.md5(F.concat_ws(":", F.col("it").cast("string"), F.col("four").cast("string"))))
    at = [F.when(F.col("four") * 4 + k < F.col("n"), draw(F.col("h"), k, F.col("n"))) for k in range(4)]
    draws = draws.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "it", "n", "mean", F.explode(F.array(*at)).alias("_p"))
    drawn = draws.join(_ranked(h, keys), _same(keys) & (F.col("p") == F.col("_p")))
    means = drawn.groupBy(*keys, "it").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum("v") / F.first("n")).alias("m"))
    ranked = means.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.array_sort(F.collect_list("m")).alias("m"))
    pick = lambda q: F.get("m", F.lit(int(q * iterations)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranked.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("mean").alias("mean"), zero(pick(alpha / 2)).alias("lo"), zero(pick(1 - alpha / 2)).alias("hi"))


def draw(digest: Column, k: int, n: int | Column) -> Column:
    """The k-th of four draws from 0 to n - 1 of an MD5, the same in every engine."""
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") % (n if isinstance(n, Column) else F.lit(n))


def with_decision(quality: DataFrame, ci: DataFrame, margin: float = MARGIN) -> DataFrame:
    """A quality report with the interval of its mean loss, and whether the worst of it is within the margin."""
    return quality.crossJoin(ci.select(F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))).withColumn("non_inferior", F.col("ci_hi") <= margin)


def report_lines(savings: DataFrame, quality: DataFrame, by_turn: DataFrame | None = None, margin: float = MARGIN) -> str:
    """A short report of one-row tables, in markdown: of savings_report, of with_decision
    for that margin (of quality_report: without interval and verdict), and of savings_by_turn."""
    s, q = savings.first(), quality.first()
    if q and not q["n"]:
        q = None
    lines = [f"- turns: {s['n']}, scored: {q['n'] if q else 0}", f"- input saved: {s['mean_saved_pct'] or 0:.1f} % (95% CI {s['ci_lo']:.1f} to {s['ci_hi']:.1f} %)", f"- cost a turn: {s['mean_cost_baseline'] or 0:.5f} to {s['mean_cost_compressed'] or 0:.5f} ({s['mean_cost_reduction_pct']:.1f} % less)"]
    if q:
        lines += [f"- quality: {q['mean_baseline']:.3f} to {q['mean_compressed']:.3f}, loss {q['mean_loss']:+.3f}"]
        if "non_inferior" in q:
            lines += [f"- loss, 95% CI {q['ci_lo']:+.3f} to {q['ci_hi']:+.3f}, margin {margin:.3f}: {'PASS, non-inferior' if q['non_inferior'] else 'FAIL, quality regressed'}"]
        lines += [f"- won, tied, lost: {q['wins']}, {q['ties']}, {q['losses']}"]
    else:
        lines += ["- quality: no scored turns"]
    turns = by_turn.orderBy("turn").collect() if by_turn is not None else []
    if turns:
        lines += ["- saved by turn: " + "  ".join(f"t{t['turn']}:{t['saved_pct']:.0f}%" for t in turns)]
    return "\n".join(lines) + "\n"
