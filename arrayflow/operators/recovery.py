"""Write-ahead-log resolution and checkpoint tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayflow.functions.ordered import keep_last

# Log operation codes, versions kept.
INTENT, COMMIT, ROLLBACK = 1, 2, 3
KEEP_VERSIONS = 3


def canonical_json(text: str) -> Column:
    """JSON text with sorted keys at every level and no spaces; text that is not JSON stays as it is.

    Numbers are equal by value: 1 and 1.0 give the same text.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.col(text))


def valid_entries(wal: DataFrame) -> DataFrame:
    """Entries whose MD5 over header and meta matches."""
    return wal.filter(F.unhex(F.md5(F.concat(F.col("header"), F.col("meta").cast("binary")))) == F.col("checksum"))


def _without(wal: DataFrame, resolving: Sequence[int], by: Sequence[str], split: int) -> DataFrame:
    """Intents no entry of the ``resolving`` kinds names: the log is read once, every meta parsed once, one exchange by key.

    A key is (``by``, offset, length, SHA-256 of the canonical meta); one with a null in it names nothing. Resolving entries
    travel as keys alone, once for each of the ``split`` parts that a key's intents are dealt to.
    """
    keys = [*by, "offset", "length", "_meta"]
    intent = F.col("op") == INTENT
    deal = F.when(intent, F.array(F.pmod(F.xxhash64(*wal.columns), F.lit(split)))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.lit(split - 1).cast("bigint")))
    entries = wal.filter(F.col("op").isin(INTENT, *resolving)).select(
        *by, "offset", "length", F.unhex(F.sha2(canonical_json("meta").cast("binary"), 256)).alias("_meta"), (~intent).alias("_resolves"),
        F.when(intent, F.struct(*wal.columns)).alias("_entry"), *([F.explode(deal).alias("_part")] if split > 1 else []))
    named = F.max("_resolves").over(Window.partitionBy(*keys, *(["_part"] if split > 1 else [])))
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    return entries.withColumn("_named", named & whole).filter("NOT _resolves AND NOT _named").select("_entry.*")


def uncommitted(wal: DataFrame, by: Sequence[str] = (), split: int = 1) -> DataFrame:
    """Write intents without a commit anywhere in the log; duplicates stay or go together.

    Where one intent is repeated so often that a task should not hold all of it, ``split`` deals each key to so many tasks.
    """
    return _without(wal, [COMMIT], by, split)


def unresolved(wal: DataFrame, by: Sequence[str] = (), split: int = 1) -> DataFrame:
    """Write intents with neither commit nor rollback; ``split`` as in :func:`uncommitted`."""
    return _without(wal, [COMMIT, ROLLBACK], by, split)


def rotate(checkpoints: DataFrame, keep: int = KEEP_VERSIONS, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``keep`` versions."""
    return keep_last(checkpoints, list(by), ["version"], keep)


def load_checkpoint(checkpoints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All rows of the newest version of which every row matches its checksum; no row where all versions are spoiled."""
    matches = F.coalesce(F.sha2(F.col("payload").cast("binary"), 256) == F.col("checksum"), F.lit(False))
    good = checkpoints.groupBy(*by, "version").agg(F.min(matches).alias("_good")).filter("_good")
    newest = good.groupBy(*by).agg(F.max("version").alias("version"))
    return checkpoints.join(newest, [*by, "version"], "left_semi")


def checkpoint_info(checkpoints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Time and versions of the checkpoint that would be loaded."""
    return load_checkpoint(checkpoints, by).select(*by, "version", "ts", "system_version", "schema_version").distinct()


def restore_health(loaded: DataFrame, failures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worker health after a restore: the saved health or, without a save, none; failed workers are ``restarted``.

    ``loaded`` holds worker health (worker, health) of the loaded checkpoint, ``failures`` the failed workers.
    """
    keys = [*by, "worker_id"]
    failed = failures.select(*keys).distinct().withColumn("_failed", F.lit(True))
    return loaded.select(*keys, "health").join(failed, keys, "full").select(
        *keys, F.when(F.col("_failed"), "restarted").otherwise(F.col("health")).alias("health"))


def restore_state(checkpoints: DataFrame, failures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The whole state after a restore, one row per entry: ``by, part, entry, value``.

    The newest version without a spoiled row is read: ``active_tasks`` (task, its place), ``buffer_usage`` (worker, buffers) and
    ``process_health`` (worker, health); failed workers (``by, worker_id``) are ``restarted``. Without such a version the state is
    empty but for them. A part that is missing in a payload, or has another type, gives no entries; payloads that are no JSON
    give none at all. Parts of several payloads add up.
    """
    by = list(by)
    state = load_checkpoint(checkpoints, by).select(*by, F.try_parse_json("payload").alias("_state"))

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get("_state", f"$.{path}", kind)
    tasks = state.select(*by, F.posexplode(part("active_tasks", "array<string>")).alias("value", "entry")).select(
        *by, F.lit("active_tasks").alias("part"), "entry", F.col("value").cast("string").alias("value"))
    buffers = state.select(*by, F.lit("buffer_usage").alias("part"), F.explode(part("buffer_usage", "map<string,bigint>")).alias("entry", "value"))
    saved = state.select(*by, F.explode(part("process_health", "map<string,string>")).alias("worker_id", "health"))
    failed = failures.select(*by, F.col("worker_id").cast("string").alias("worker_id"))
    health = restore_health(saved, failed, by).select(*by, F.lit("process_health").alias("part"), F.col("worker_id").alias("entry"), F.col("health").alias("value"))
    return tasks.unionByName(buffers.withColumn("value", F.col("value").cast("string"))).unionByName(health)


def recovery_events(log_events: DataFrame) -> DataFrame:
    """Failure, restart, restore and checkpoint messages as a timeline."""
    text = F.lower("message")
    kind = (F.when(text.contains("unresponsive"), "failure").when(text.contains("restarted"), "restart")
            .when(text.rlike("restored|resumed"), "restore").when(text.contains("checkpoint"), "checkpoint"))
    worker = F.nullif(F.regexp_extract("message", r"(?i)process (\d+)", 1), F.lit("")).cast("bigint")
    return (log_events.select("ts", "seq", kind.alias("event"), F.coalesce(worker, F.col("worker_id")).alias("worker_id"), "message")
            .filter(F.col("event").isNotNull()))

