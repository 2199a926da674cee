"""Worker-skew analysis over snapshot tables: overload, moves, scores, recommendations, adaptive thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.functions.expr import attach, floor_div
from arrayflow.functions.ordered import keep_last, last_known, number, running_sum, slice_rows, trailing_sum
from arrayflow.session import pinned

# Overload marks, gate, move estimate, score weights, learning rule.
QUEUE_MARK, CPU_MARK, LOAD_MARK, IDLE_MARK, MARKS_NEEDED = 5, 90.0, 0.8, 0.1, 2
GATE_VARIANCE, GATE_MEAN = 0.1, 0.3
UNDERUSED_IDLE, UNDERUSED_QUEUE = 0.5, 2
SOURCE_RELIEF, TARGET_COST, IDLE_BONUS, IDLE_BONUS_ABOVE = 0.2, 0.3, 1.5, 0.7
MOVED_SOURCE, MOVED_TARGET = 0.8, 1.2
RECENT_MOVES, RECENT_SUCCESS = 10, 20
LOW_SUCCESS = 0.8
RAISE_BELOW, LOWER_ABOVE, RATE, LOWEST, HIGHEST = 0.5, 0.8, 0.05, 0.1, 0.8
LOAD_SAMPLES = 50
UNKNOWN_IDLE = 100.0

# Most rows of one fold of the adaptive threshold.
STRETCH = 256


def overload_marks(queue: Column, cpu: Column, load: Column, idle: Column) -> Column:
    marks = [queue > QUEUE_MARK, cpu > CPU_MARK, load > LOAD_MARK, idle < IDLE_MARK]
    return sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks[1:]), F.coalesce(marks[0], F.lit(False)).cast("int"))


def overload_flags(workers: DataFrame) -> DataFrame:
    """Count the overload marks; two of four make a worker overloaded."""
    marks = overload_marks(F.col("queue_size"), F.col("cpu_usage"), F.col("current_load"), F.col("idle_probability"))
    return workers.withColumn("marks", marks).withColumn("is_overloaded", F.col("marks") >= MARKS_NEEDED)


def imbalance_gate(workers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether a group's load is uneven enough for moves: sample variance and mean of the load."""
    variance, mean = F.var_samp("current_load"), F.avg("current_load")
    gate = F.coalesce((variance > GATE_VARIANCE) & (mean > GATE_MEAN), F.lit(False))
    return workers.groupBy(*by).agg(variance.alias("variance"), mean.alias("mean"), gate.alias("gate"))


def underused(workers: DataFrame) -> DataFrame:
    """Workers with idle time and a short queue."""
    return workers.filter((F.col("idle_probability") > UNDERUSED_IDLE) & (F.col("queue_size") < UNDERUSED_QUEUE))


def improvement(source_load: Column, target_load: Column, target_idle: Column) -> Column:
    """Expected gain of one move, never negative."""
    net = source_load * SOURCE_RELIEF - target_load * TARGET_COST
    return F.greatest(F.lit(0.0), F.when(target_idle > IDLE_BONUS_ABOVE, net * IDLE_BONUS).otherwise(net))


def move_improvement(pairs: DataFrame) -> DataFrame:
    """Add the expected gain to rows that already pair a source with a target."""
    return pairs.withColumn("improvement", improvement(F.col("source_load"), F.col("target_load"), F.col("target_idle")))


def move_candidates(workers: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Per overloaded worker that can be relieved, where the gate is open: ``source_id, target_id, improvement, n_targets``.

    "gain > threshold" is "relief of the source > bar of the target". Reliefs and bars are put in one order, in which the
    bars counted so far are a source's ``n_targets``: no pair is formed. The target with the highest gain (of equal ones, the
    lowest id) has the lowest load of those with the idle bonus or of those without it, so that the two lowest of both kinds,
    one of which may be the source itself, decide for a whole group.
    """
    by = list(by)
    flagged = attach(overload_flags(workers), imbalance_gate(workers, by).select(*by, "gate"), by).filter("gate")
    bonus = F.col("idle_probability") > IDLE_BONUS_ABOVE
    relief = F.col("current_load") * SOURCE_RELIEF
    bar = F.col("current_load") * TARGET_COST + F.lit(float(threshold)) / F.when(bonus, IDLE_BONUS).otherwise(1.0)
    takes = (F.col("idle_probability") > UNDERUSED_IDLE) & (F.col("queue_size") < UNDERUSED_QUEUE)
    none = F.lit(False)
    sides = F.array(F.when(F.coalesce("is_overloaded", none), F.struct(relief.alias("value"), F.lit(0).alias("bars"))),
                    F.when(F.coalesce(takes, none), F.struct(bar.alias("value"), F.lit(1).alias("bars"))))
    own = F.when(F.coalesce(takes & (bar < relief), none), 1).otherwise(0)
    entries = flagged.select(*by, "worker_id", "current_load", own.alias("_own"), F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select(
        *by, "worker_id", "current_load", "_own", "s.value", "s.bars")
    # A whole number that rises with the value leads the order, so that large groups can be cut. Equal bars are not below.
    placed = entries.withColumn("_level", F.floor(F.col("value") * float(1 << 40)))
    counted = running_sum(placed, by, ["_level", "value", "bars", "worker_id"], {"_below": "bars"})
    sources = counted.filter("bars = 0").select(*by, F.col("worker_id").alias("source_id"), F.col("current_load").alias("source_load"),
                                                (F.col("_below") - F.col("_own")).alias("n_targets")).filter("n_targets > 0")

    lowest = W.partitionBy(*by, "bonus").orderBy("current_load", "worker_id")
    few = underused(flagged).select(*by, bonus.alias("bonus"), "worker_id", "current_load", "idle_probability").withColumn(
        "_rank", F.row_number().over(lowest)).filter("_rank <= 2")
    known = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("worker_id", "current_load", "idle_probability"))).alias("_few"))
    joined = attach(sources, known, by)
    others = F.filter("_few", lambda t: t["worker_id"] != F.col("source_id"))
    gains = F.transform(others, lambda t: F.struct(improvement(F.col("source_load"), t["current_load"], t["idle_probability"]).alias("improvement"), (-t["worker_id"]).alias("low_id_first")))
    best = F.array_max(gains)
    return joined.withColumn("_best", best).select(*by, "source_id", (-F.col("_best.low_id_first")).alias("target_id"), F.col("_best.improvement").alias("improvement"), "n_targets")


def move_pairs(workers: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Every move from an overloaded to an underused worker of its group whose gain exceeds ``threshold``, where the gate is
    open: ``source_id, target_id, improvement``.

    The result itself is quadratic in a group, so that groups should be of bounded size; :func:`move_candidates` needs no pairs.
    """
    by = list(by)
    flagged = attach(overload_flags(workers), imbalance_gate(workers, by).select(*by, "gate"), by).filter("gate")
    sources = flagged.filter("is_overloaded").select(*by, F.col("worker_id").alias("source_id"), F.col("current_load").alias("source_load"))
    targets = underused(flagged).select(*by, F.col("worker_id").alias("target_id"), F.col("current_load").alias("target_load"), F.col("idle_probability").alias("target_idle"))
    pairs = sources.join(targets, by) if by else sources.crossJoin(targets)
    enough = (F.col("source_id") != F.col("target_id")) & (F.col("improvement") > threshold)
    return move_improvement(pairs).filter(enough).select(*by, "source_id", "target_id", "improvement")


def project_moves(workers: DataFrame, moves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both workers' state after each move taken alone, with the overload flag decided anew."""
    by = list(by)
    state = ["current_load", "queue_size", "cpu_usage", "idle_probability"]

    def side(prefix: str) -> DataFrame:
        return workers.select(*by, F.col("worker_id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in state])
    joined = moves.join(side("source"), [*by, "source_id"]).join(side("target"), [*by, "target_id"])
    source_load = F.col("source_current_load") * MOVED_SOURCE
    source_queue = F.greatest(F.lit(0), F.col("source_queue_size") - 1)
    target_load = F.least(F.lit(1.0), F.col("target_current_load") * MOVED_TARGET)
    target_queue = F.col("target_queue_size") + 1

    def overloaded(prefix: str, load: Column, queue: Column) -> Column:
        return overload_marks(queue, F.col(f"{prefix}_cpu_usage"), load, F.col(f"{prefix}_idle_probability")) >= MARKS_NEEDED
    return joined.select(
        *by, "source_id", "target_id", source_load.alias("source_load"), source_queue.alias("source_queue"),
        overloaded("source", source_load, source_queue).alias("source_overloaded"),
        target_load.alias("target_load"), target_queue.alias("target_queue"),
        overloaded("target", target_load, target_queue).alias("target_overloaded"))


def _score(complex_task: Column) -> Column:
    base = (F.col("idle_probability") * 10 - F.col("queue_size") * 2 - F.col("cpu_usage") / 100 * 5
            + (1 - F.col("memory_usage") / 100) * 2)
    return (base - F.when(F.col("is_overloaded"), 10).otherwise(0)
            - F.when(complex_task, F.col("current_load") * 5).otherwise(0.0))


def worker_score(workers: DataFrame, complexity: float | Column = 1.0) -> DataFrame:
    """Fitness of every worker for a task; above complexity 1 the load counts too."""
    complexity = complexity if isinstance(complexity, Column) else F.lit(complexity)
    return overload_flags(workers).withColumn("score", _score(complexity > 1.0))


def best_worker(workers: DataFrame, tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best worker of the group for each task. Only "complex or not" matters, so two winners per group serve all tasks."""
    by = list(by)
    scored = overload_flags(workers)

    def winner(is_complex: bool) -> Column:
        return F.max_by("worker_id", F.struct(_score(F.lit(is_complex)).alias("score"), (-F.col("worker_id")).alias("low_id_first")))
    winners = scored.groupBy(*by).agg(winner(False).alias("_plain"), winner(True).alias("_complex"))
    pick = F.when(F.col("complexity") > 1.0, F.col("_complex")).otherwise(F.col("_plain"))
    return attach(tasks, winners, by).withColumn("worker_id", pick).drop("_plain", "_complex")


def balance_score(workers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 for an even load, falling with its sample variance; 1 where there is nothing to compare."""
    score = F.greatest(F.lit(0.0), 1 - F.var_samp("current_load"))
    return workers.groupBy(*by).agg(F.coalesce(F.when(F.count(F.lit(1)) > 1, score), F.lit(1.0)).alias("balance_score"))


def recommendations(workers: DataFrame, moves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Advice rows: overloaded workers, idle workers, a low share of successful moves."""
    by = list(by)
    counts = overload_flags(workers).groupBy(*by).agg(
        F.count_if("is_overloaded").alias("overloaded"), F.count_if(F.col("idle_probability") > IDLE_BONUS_ABOVE).alias("idle"))
    rate = F.avg(F.col("success").cast("double"))
    success = moves.groupBy(*by).agg(rate.alias("rate"))
    n_over, n_idle = F.col("overloaded"), F.col("idle")
    options = F.array(
        F.when(n_over > 0, F.struct(F.lit("overload").alias("topic"), F.format_string("add %d workers", n_over).alias("message"))),
        F.when(n_idle > 0, F.struct(F.lit("idle").alias("topic"), F.format_string("%d workers underused", n_idle).alias("message"))))
    from_workers = counts.select(*by, F.explode(F.filter(options, lambda m: m.isNotNull())).alias("m")).select(*by, "m.topic", "m.message")
    from_moves = success.filter(F.col("rate") < LOW_SUCCESS).select(
        *by, F.lit("moves").alias("topic"), F.lit("few moves succeed, review the strategy").alias("message"))
    return from_workers.unionByName(from_moves)


def move_effect(moves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of moves, and the mean gain of the last ten."""
    by = list(by)
    total = F.count(F.lit(1))
    totals = moves.groupBy(*by).agg(total.alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))
    recent = keep_last(moves, by, ["seq"], RECENT_MOVES).groupBy(*by).agg(F.avg("improvement").alias("recent_improvement"))
    return attach(totals, recent, by)


def recent_success(moves: DataFrame, n: int = RECENT_SUCCESS, by: Sequence[str] = ()) -> DataFrame:
    """Share of successes among the last ``n`` moves."""
    share = F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0))
    return keep_last(moves, list(by), ["seq"], n).groupBy(*by).agg(share.alias("success_rate"), F.count(F.lit(1)).alias("n"))


def _bounded(value: Column, step: Column) -> Column:
    """Apply one map t -> min(hi, max(lo, a t))."""
    return F.least(step["hi"], F.greatest(step["lo"], value * step["a"]))


def _fold_groups(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ordered maps (pos, step) in groups of ``STRETCH``: their array and the one map they compose to."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "step")))
    grouped = steps.groupBy(*by, floor_div(F.col("pos"), STRETCH).alias("group")).agg(ordered.alias("steps"))
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def compose(acc: Column, row: Column) -> Column:
        step = row["step"]
        return F.struct((acc["a"] * step["a"]).alias("a"), _bounded(acc["lo"], step).alias("lo"), _bounded(acc["hi"], step).alias("hi"))
    return grouped.withColumn("whole", F.aggregate("steps", identity, compose))


def _replay(start: Column) -> Column:
    """(pos, before, after) of every map in ``steps``, from a start value."""
    rows = F.array().cast("array<struct<pos:bigint,before:double,after:double>>")

    def step(acc: Column, row: Column) -> Column:
        after = _bounded(acc["t"], row["step"])
        made = F.struct(row["pos"].alias("pos"), acc["t"].alias("before"), after.alias("after"))
        return F.struct(after.alias("t"), F.concat(acc["rows"], F.array(made)).alias("rows"))
    return F.aggregate("steps", F.struct(start.alias("t"), rows.alias("rows")), step)["rows"]


def adaptive_threshold(moves: DataFrame, start: float, by: Sequence[str] = ()) -> DataFrame:
    """Threshold after every move: from the tenth on it follows the success rate of the last ten, within bounds.

    One move maps t to min(hi, max(lo, a t)), and such maps compose to maps of the same form. Stretches of moves are
    composed in parallel, stretches of stretches again; a fold over the few that remain gives start values, from which
    the stretches are replayed, again in parallel.
    """
    by = list(by)
    # Written once: the steps below read their input many times.
    rows = slice_rows(pinned(moves.select(*by, "seq", "success")), by, ["seq"])
    numbered = number(rows, by, ["seq"], "_pos")
    rated = trailing_sum(numbered, by, ["seq"], RECENT_MOVES, {"_good": F.col("success").cast("bigint")}).withColumnRenamed("_pos", "_rn")
    rate = F.col("_good") / float(RECENT_MOVES)
    factor = F.when(rate > LOWER_ABOVE, 1 - RATE).when(rate < RAISE_BELOW, 1 + RATE).otherwise(1.0)
    counted = F.col("_rn") >= RECENT_MOVES

    def bound(value: float, none: str) -> Column:
        return F.when(counted, F.lit(value)).otherwise(F.lit(float(none)))
    step = F.struct(F.when(counted, factor).otherwise(1.0).alias("a"), bound(LOWEST, "-inf").alias("lo"), bound(HIGHEST, "inf").alias("hi"))
    placed = rated.select(*by, "seq", (F.col("_rn") - 1).alias("pos"), step.alias("step"))

    stretches = _fold_groups(placed.select(*by, "pos", "step"), by)
    spans = _fold_groups(stretches.select(*by, F.col("group").alias("pos"), F.col("whole").alias("step")), by)
    # One row per STRETCH * STRETCH moves is left to fold in a single array.
    top = spans.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("group").alias("pos"), F.col("whole").alias("step")))).alias("steps"))

    def starts(grouped: DataFrame, start: Column) -> DataFrame:
        return grouped.select(*by, F.explode(_replay(start)).alias("r")).select(*by, F.col("r.pos").alias("group"), F.col("r.before").alias("start"))
    span_starts = starts(top, F.lit(float(start)))
    stretch_starts = starts(spans.join(span_starts, [*by, "group"]), F.col("start"))
    replayed = stretches.join(stretch_starts, [*by, "group"]).select(*by, F.explode(_replay(F.col("start"))).alias("r"))
    thresholds = replayed.select(*by, "r.pos", F.col("r.after").alias("threshold"))
    return placed.select(*by, "seq", "pos").join(thresholds, [*by, "pos"]).select(*by, "seq", "threshold")


def assign_tasks(candidates: DataFrame, stats: DataFrame, policy: str = "min_idle", capacity: int | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """One worker per task from its candidates (task_id, position, worker_id).

    ``min_idle`` takes the smallest idle percentage, ``max_idle`` the largest; a worker without statistics counts as 100
    and the earlier candidate wins ties. With ``capacity`` a task whose ``batch_size`` is larger gets none.
    """
    idle = F.coalesce("idle_percentage", F.lit(UNKNOWN_IDLE))
    sign = {"min_idle": 1, "max_idle": -1}[policy]
    keys = [*by, "worker_id"]
    joined = candidates.join(stats.select(*keys, "idle_percentage"), keys, "left")
    chosen = F.min_by("worker_id", F.struct((idle * sign).alias("idle"), "position"))
    if capacity is not None:
        chosen = F.when(F.max("batch_size") <= capacity, chosen)
    return joined.groupBy(*by, "task_id").agg(chosen.alias("worker_id"))


def load_history(samples: DataFrame, fields: Sequence[str], n: int = LOAD_SAMPLES, by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` samples of every worker; a missing field carries its previous value."""
    keys = [*by, "worker_id"]
    carried = last_known(samples, keys, ["ts", "seq"], {f"_{f}": f for f in fields})
    filled = carried.select(*keys, "ts", "seq", *[F.col(f"_{f}").alias(f) for f in fields])
    return keep_last(filled, keys, ["ts", "seq"], n)
