"""Streaming versions: event counts, sessions, routing, arrival de-duplication and keyed state.

``run`` drives a query over what its source holds now and returns the sink as a frame; the same plans
run continuously with another trigger.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvella.plans.storage import fresh_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream with session-zone timestamps."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, mode: str, label: str) -> DataFrame:
    """Process all there is; complete mode keeps the last table, append mode every batch."""
    spark, out = df.sparkSession, fresh_path(df.sparkSession, label)
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{label}-state")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def replay(table: DataFrame, order: str | None = None, batches: int = 1) -> DataFrame:
    """A table as a stream, by way of the shared folder: all at once, or range by range of ``order`` in about so many batches."""
    spark, path = table.sparkSession, fresh_path(table.sparkSession, "replay")
    if order is None:
        table.write.parquet(path)
        return spark.readStream.schema(table.schema).parquet(path)
    numbered = table.repartitionByRange(batches, order).withColumn("_part", F.spark_partition_id())
    kept = fresh_path(spark, "replay-ranges")
    numbered.write.partitionBy("_part").parquet(kept)
    for k in range(batches):  # files are taken in the order of their times
        spark.read.schema(numbered.schema).parquet(kept).filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and type (R2)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per user: start, end, events, last type."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last_type")


def routed(events: DataFrame, topics: dict[str, str], default: str = "other") -> DataFrame:
    """Canonical topic and room of each event."""
    m = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    return events.withColumn("topic", F.coalesce(m[F.col("event_type")], F.lit(default))).withColumn("room", F.concat(F.lit("task-"), F.col("user_id")))


def first_arrivals(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first arrival per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_state(events: DataFrame) -> DataFrame:
    """Running count and last event per user: two aggregates, whose state Spark keeps."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), last.alias("last_type"))


def screening(decisions: DataFrame) -> DataFrame:
    """Stage of each record after the decisions so far, and whether two reviewers of one stage disagree.

    Input: record, reviewer, stage, decision, reason, seq. An exclusion without a reason does not count; of a
    reviewer's decisions at a stage the last by ``seq`` does. A stage moves on the last decision that counts.
    """
    sound = decisions.filter("decision = 'include' OR (decision = 'exclude' AND coalesce(trim(reason), '') <> '')")
    at = lambda stage: F.max_by(F.when(F.col("stage") == stage, F.col("decision")), F.when(F.col("stage") == stage, F.col("seq")))
    said = lambda stage, d: F.count_distinct(F.when((F.col("stage") == stage) & (F.col("decision") == d), F.col("reviewer")))
    last = sound.groupBy("record", "stage", "reviewer").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("seq"))
    first, second = at("title_abstract"), at("full_text")
    state = F.when(first.isNull(), "title_abstract").when(first == "exclude", "excluded").when(second.isNull(), "full_text").when(second == "include", "included").otherwise("excluded")
    split = lambda stage: (said(stage, "include") > 0) & (said(stage, "exclude") > 0)
    return last.groupBy("record").agg(state.alias("stage"), (split("title_abstract") | split("full_text")).alias("conflict"))


def fresh_values(events: DataFrame, keys: list[str], ttl: str, late: str = "1 day") -> DataFrame:
    """(keys, ts) of the events that set an entry (R6): an entry lives until more than ``ttl`` after it was set, and while it does, events of its key are dropped.

    State is one number per key, when its entry was set; a timer on the event clock takes it away once the watermark has
    passed its end, so dead keys cost nothing. An event that comes in a later batch than a younger one that set the entry is dropped if it
    falls within ``ttl`` before that. Events without a time are left out; a null key is a key.
    """
    life = int(pd.Timedelta(ttl).value // 1000)  # microseconds

    def apart(at: np.ndarray) -> list[int]:
        """The first time, the first that is more than ``life`` later, and so on."""
        out, i = [], 0
        while i < len(at):
            out.append(int(at[i]))
            i = int(np.searchsorted(at, at[i] + life, side="right"))
        return out

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = np.sort(np.concatenate([f["at"].to_numpy(np.int64) for f in frames]))
        if state.exists:
            kept = state.get[0]
            late_ones, fresh = apart(at[: np.searchsorted(at, kept - life)]), apart(at[np.searchsorted(at, kept + life, side="right") :])
        else:
            kept, late_ones, fresh = None, [], apart(at)
        kept = fresh[-1] if fresh else kept
        state.update((kept,))
        state.setTimeoutTimestamp(max((kept + life) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        found = late_ones + fresh
        if found:
            yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key, strict=True)}, "at": found})

    timed = events.withWatermark("ts", late).filter("ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).select("ts", "at", *keys)
    schema = ", ".join([*(f"`{k}` {timed.schema[k].dataType.simpleString()}" for k in keys), "at long"])
    found = timed.groupBy(*keys).applyInPandasWithState(step, schema, "set_at long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*keys, F.timestamp_micros("at").alias("ts"))


def screening_transitions(decisions: DataFrame) -> DataFrame:
    """Moves of records between stages, as their decisions stream in (R5): record, seq, was, stage, conflict.

    State per record is the last counted decision of each reviewer at each stage, with its ``seq``, so it does not matter in which batch or
    order decisions arrive: after the last one, the stage and the conflict flag are those of ``screening``. A row comes out when either changes.
    """

    def judged(known: dict) -> tuple[str, bool]:
        last, split = {}, False
        for stage in ("title_abstract", "full_text"):
            said = [(seq, d) for (st, _), (seq, d) in known.items() if st == stage]
            last[stage] = max(said)[1] if said else None
            split |= len({d for _, d in said}) > 1
        if last["title_abstract"] != "include":
            return ("title_abstract" if last["title_abstract"] is None else "excluded"), split
        return {None: "full_text", "include": "included"}.get(last["full_text"], "excluded"), split

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {tuple(k): tuple(v) for k, v in json.loads(state.get[0])} if state.exists else {}
        stage, conflict = judged(known)
        moves = []
        for r in pd.concat(list(frames)).sort_values(["seq", "reviewer"], kind="stable").itertuples(index=False):
            if known.get((r.stage, r.reviewer), (-math.inf,))[0] < r.seq:
                known[r.stage, r.reviewer] = (int(r.seq), r.decision)
                now = judged(known)
                if now != (stage, conflict):
                    moves.append((key[0], int(r.seq), stage, *now))
                    stage, conflict = now
        state.update((json.dumps([[list(k), list(v)] for k, v in known.items()]),))
        if moves:
            yield pd.DataFrame(moves, columns=["record", "seq", "was", "stage", "conflict"])

    sound = decisions.filter("record IS NOT NULL AND seq IS NOT NULL AND (decision = 'include' OR (decision = 'exclude' AND coalesce(trim(reason), '') <> ''))")
    kind = decisions.schema["record"].dataType.simpleString()
    asked = sound.select("record", F.coalesce("reviewer", F.lit("")).alias("reviewer"), "stage", "decision", F.col("seq").cast("long").alias("seq"))
    return asked.groupBy("record").applyInPandasWithState(step, f"record {kind}, seq long, was string, stage string, conflict boolean", "known string", "append", GroupStateTimeout.NoTimeout)


def online_burst_cost(days: DataFrame, base: float, s: float = 2.0, gamma: float = 1.0, n: int = 30) -> DataFrame:
    """The forward pass of the two-state burst automaton, carried as state per key.

    Input: key, day, count (one row per key and day, in order of days over batches). ``base`` is the idle rate and ``n`` the length
    of series that the cost of entering a burst is set for; both are known beforehand, as a stream has no end.
    Gives key, days, idle and burst: the least cost of ending idle and of ending in a burst. State is three numbers.
    """
    up, rates = gamma * math.log(n), (base, base * s)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, idle, burst = state.get if state.exists else (0, 0.0, up)
        for c in pd.concat(list(frames)).sort_values("day")["count"].to_numpy(float):
            cost = [r - c * math.log(r) for r in rates]
            if seen:
                idle, burst = min(idle, burst) + cost[0], min(idle + up, burst) + cost[1]
            else:
                idle, burst = cost[0], up + cost[1]
            seen += 1
        state.update((seen, idle, burst))
        yield pd.DataFrame({"key": [key[0]], "days": [seen], "idle": [idle], "burst": [burst]})

    return days.groupBy("key").applyInPandasWithState(step, "key string, days long, idle double, burst double", "n long, a double, b double", "update", GroupStateTimeout.NoTimeout)
