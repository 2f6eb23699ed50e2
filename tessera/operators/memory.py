"""Memory value, decay, tiers and lifecycle. Times are epoch milliseconds; `now_ms` is always given.

Decisions the specification leaves open are named where they are made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import SLICE_ROWS, numbered, sliced

DAY_MS = 86_400_000
DECAY = math.log(2) / 30
ALPHA, BETA, NEGATIVE, MOST = 0.08, 0.20, 0.08, 1.0
TIERS = {"hot_up": 0.70, "hot_down": 0.62, "warm_up": 0.45, "warm_down": 0.25}


def clamp(x: Column, low: float, high: float) -> Column:
    """Null is the lower bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(F.lit(low))  # greatest and least skip nulls


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def token_estimate(text: str) -> Column:
    """M3: a quarter of the characters of the trimmed text, at least 1; 0 for blank text."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, 0).otherwise(F.ceil(n / 4)).cast("long")


def recency(reference_ms: Column, now_ms: int, scale_days: float) -> Column:
    """M2, H7: exp(-age / scale): an e-folding time, whatever it is called elsewhere."""
    return clamp(F.exp(-F.greatest(F.lit(0.0), (now_ms - reference_ms) / DAY_MS) / scale_days), 0, 1)


def value_score(now_ms: int, tokens: Column, scale_days: float = 30, cost_tokens: float = 2000) -> Column:
    """M1: the value of an item from reuse, utility, novelty, trust, recency, importance and cost."""
    z = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    x = (
        1.2 * F.log1p(F.greatest(F.lit(0), z("reuse_count", 0))) + 2.0 * clamp(z("utility_ema", 0.0), -1, 1) + (1 - clamp(z("redundancy", 0.0), 0, 1)) + clamp(z("trust", 0.5), 0, 1)
        + 0.5 * recency(F.coalesce("last_used_ms", "created_ms", F.lit(now_ms)), now_ms, scale_days) + clamp(z("importance", 0.0), -1, 1) - clamp(tokens / cost_tokens, 0, 2)
    )
    return clamp(sigmoid(x), 0, 1)


def decayed(value: Column, since_ms: Column, now_ms: int, rate: float = DECAY) -> Column:
    """M4: true half-life decay since the last change; rate 0 under the lru policy."""
    return value * F.exp(-rate * F.greatest(F.lit(0.0), (now_ms - since_ms) / DAY_MS))


def next_tier(tier: Column, value: Column, pinned: Column) -> Column:
    """M6: hysteresis between tiers; a pinned item is never demoted."""
    up = F.when((tier == "WARM") & (value > TIERS["hot_up"]), "HOT").when((tier == "COLD") & (value >= TIERS["warm_up"]), "WARM")
    return up.when((tier == "HOT") & (value < TIERS["hot_down"]) & ~pinned, "WARM").when((tier == "WARM") & (value < TIERS["warm_down"]) & ~pinned, "COLD").otherwise(tier)


def event_effect(kind: str) -> float:
    """M5: what an event adds to a value. Negative feedback takes off; unknown kinds do nothing."""
    return {"retrieved": ALPHA, "used_in_answer": ALPHA + BETA, "user_positive": ALPHA + BETA, "user_negative": -NEGATIVE}.get(kind, 0.0)


def fold_values(events: DataFrame, key: str = "memory_id", start: float = 0.5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """M5: the value of each item after its events in order (by ms, event_id): decay since the last one, effect, cap.

    The cap makes order matter. A step is v -> min(MOST, max(0, v * d + e)); such steps compose to steps of the form
    min(c, max(b, v * a + s)), so a history folds in any grouping. Histories are cut into slices of time first, by a range
    partitioning of all events; a slice knows its composed step and its first and last time, and the slices of an item
    are stitched with the decay across the gap between them. No item's history is sorted or gathered as one.
    """
    slices = sliced(events.select(key, "ms", "event_id", "kind"), [key], ["ms", "event_id"], slice_rows, "event_slices")
    w = Window.partitionBy(key, "_slice").orderBy("ms", "event_id")
    faded = lambda ms, before: F.exp(-DECAY * F.coalesce((ms - before) / DAY_MS, F.lit(0.0)))
    effect = F.create_map(*[x for k in ("retrieved", "used_in_answer", "user_positive", "user_negative") for x in (F.lit(k), F.lit(event_effect(k)))])
    steps = slices.withColumn("a", faded(F.col("ms"), F.lag("ms").over(w))).withColumn("s", F.coalesce(F.element_at(effect, F.col("kind")), F.lit(0.0)))
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("b"), F.lit(float("inf")).alias("c"))

    def then(f: Column, a: Column, s: Column, b: Column, c: Column) -> Column:
        low = lambda x: F.least(c, F.greatest(b, x))
        return F.struct((f.a * a).alias("a"), (f.s * a + s).alias("s"), low(F.greatest(b, f.b * a + s)).alias("b"), low(f.c * a + s).alias("c"))

    def stitched(done: Column, own: Column) -> Column:
        """The steps so far, the decay up to the slice, the slice."""
        return F.struct(then(done.f, faded(own.first, done.last) * own.f.a, own.f.s, own.f.b, own.f.c).alias("f"), own.last.alias("last"))

    own = steps.groupBy(key, "_slice").agg(F.array_sort(F.collect_list(F.struct("ms", "event_id", "a", "s"))).alias("e"), F.min("ms").alias("first"), F.max("ms").alias("last"), F.count("*").alias("events"))
    own = own.withColumn("f", F.aggregate("e", unit, lambda f, e: then(f, e.a, e.s, F.lit(0.0), F.lit(MOST))))
    whole = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_slice", "first", "last", "f"))).alias("e"), F.sum("events").alias("events"))  # a row a slice
    whole = whole.withColumn("f", F.aggregate("e", F.struct(unit.alias("f"), F.lit(None).cast("long").alias("last")), stitched).f)
    return whole.select(key, "events", F.least("f.c", F.greatest("f.b", start * F.col("f.a") + F.col("f.s"))).alias("value"))


def too_young(created_ms: Column, now_ms: int, hours: float) -> Column:
    """M7: missing dates and hours of 0 or less never block."""
    return F.coalesce((now_ms - created_ms) < hours * 3_600_000, F.lit(False)) if hours > 0 else F.lit(False)


def within_budget(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """M8: at most `limit` rows; 0 is no limit."""
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows


def lifecycle(items: DataFrame, now_ms: int, min_age_hours: float = 24, group: int = 5) -> DataFrame:
    """M9: delete, summarise, promote or keep, by value; those to be summarised are compacted in groups within tenant.

    The order of the thresholds (delete first, promote last) is a decision made here."""
    young = too_young(F.col("created_ms"), now_ms, min_age_hours)
    action = F.when(young | F.col("pinned"), "keep").when(F.col("value_score") < 0.25, "delete").when(F.col("value_score") < 0.45, "summarize").when(F.col("value_score") >= 0.70, "promote").otherwise("keep")
    acted = items.select("id", "tenant_id", "collection", action.alias("action"))
    told = numbered(acted.filter("action = 'summarize'"), ["tenant_id", "collection"], ["id"], "_i", "_n").withColumn("compact_group", F.ceil(F.col("_i") / group).cast("long"))
    return acted.filter("action != 'summarize'").withColumn("compact_group", F.lit(None).cast("long")).unionByName(told.drop("_i", "_n"))


def redundancy(vectors: DataFrame, tile_rows: int = 4096) -> DataFrame:
    """The largest cosine to another vector of the same block and length, within 0 .. 1; 0 if alone.

    The measure is a decision made here. A block is cut into tiles by hash, and two tiles meet as a matrix product that
    gives each row's best: no pairs of rows leave a task, and a block of any size is many tasks. Vectors null, zero or
    with components that are null or not finite have 0; of rows that repeat an id the others count as other vectors."""
    rows = vectors.select("id", "vec", "block", F.coalesce(F.size("vec"), F.lit(-1)).alias("d"))
    counts = rows.groupBy("block", "d").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")).select(F.col("block").alias("_block"), F.col("d").alias("_d"), "tiles")
    tiled = rows.filter("d > 0").join(counts, F.col("block").eqNullSafe(F.col("_block")) & (F.col("d") == F.col("_d")))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id", "vec"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = tiled.select("block", "d", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id", "vec")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for _, g in group.groupby("tile"):
            x = np.stack([np.asarray(v, np.float64) for v in g["vec"]])
            x[~np.isfinite(x).all(axis=1)] = 0
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            sides.append((g["id"], x / np.where(norm > 0, norm, 1)))
        (ids, x), (others, y) = sides[0], sides[-1]
        scores = x @ y.T
        if len(sides) == 1:  # a tile with itself, or with one that has no rows
            np.fill_diagonal(scores, 0)
            return pd.DataFrame({"id": ids, "best": scores.max(axis=1)})
        return pd.DataFrame({"id": pd.concat([ids, others]), "best": np.concatenate([scores.max(axis=1), scores.max(axis=0)])})

    found = pairs.groupBy("block", "d", "a", "b").applyInPandas(meet, f"id {rows.schema['id'].dataType.simpleString()}, best double").groupBy(F.col("id").alias("_id")).agg(F.max("best").alias("best"))
    return vectors.select("id").distinct().join(found, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", F.round(clamp(F.col("best"), 0, 1), 6).alias("redundancy"))


def feedback_event(feedback: Column) -> Column:
    """M15."""
    return F.when(feedback == "positive", "user_positive").when(feedback == "negative", "user_negative").when(feedback == "success", "task_success").otherwise(feedback)


def draw(seed: int, key: str) -> Column:
    """A seeded draw of each key, as hex digits that order at random."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def tier_gate(items: DataFrame, k: int, multiplier: int, cold_share: float, seed: int, sample: str = "random") -> DataFrame:
    """All HOT items, k of the best k * multiplier WARM ones, and a seeded share of COLD ones.

    WARM ones are sampled at random by a seeded draw, or 'lru': those used longest ago first, never used ones before (a decision made here)."""
    hot = items.filter("tier = 'HOT'")
    pool = items.filter("tier = 'WARM'").orderBy(F.desc("value_score"), "id").limit(k * multiplier)
    order = F.asc_nulls_first("last_used_ms") if sample == "lru" else draw(seed, "id")
    warm = pool.orderBy(order, "id").limit(k)
    cold = items.filter((F.col("tier") == "COLD") & (F.conv(F.substring(draw(seed, "id"), 1, 6), 16, 10).cast("int") < F.lit(int(cold_share * 16**6))))
    return hot.unionByName(warm).unionByName(cold)


def gate_counts(gated: DataFrame, k: int) -> DataFrame:
    """One row of what the gate let through, and its bound: all HOT, at most k WARM, and the COLD probed."""
    count = lambda tier: F.count_if(F.col("tier") == tier)
    counts = gated.agg(count("HOT").alias("hot_count"), count("WARM").alias("warm_sampled"), count("COLD").alias("cold_candidates"), F.count("*").alias("retrieval_set_size"))
    counts = counts.withColumn("retrieval_bound", F.col("hot_count") + k + F.col("cold_candidates"))
    return counts.withColumn("bounded", F.col("retrieval_set_size") <= F.col("retrieval_bound"))


def recorded_events(events: DataFrame, now_ms: int) -> DataFrame:
    """The events that can be recorded: a type that isn't blank, trimmed, and a finite value; without a time, now.

    Others are dropped; a value that is null counts as not finite."""
    value = F.col("event_value").cast("double")
    valid = (F.trim(F.coalesce("event_type", F.lit(""))) != "") & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return events.filter(valid).withColumns({"event_type": F.trim("event_type"), "event_value": value, "created_ms": F.coalesce("created_ms", F.lit(now_ms))})


LINK_KEY = ["tenant_id", "from_item_id", "to_item_id", "relation"]


def new_links(links: DataFrame, stored: DataFrame) -> DataFrame:
    """The links that aren't stored yet, one of each key. Keys with a null part are dropped; metadata of repeats: the least."""
    asked = links.dropna(subset=LINK_KEY).groupBy(*LINK_KEY).agg(F.min("metadata").alias("metadata"))
    return asked.join(stored.select(*LINK_KEY), LINK_KEY, "left_anti")


def last_writes(log: DataFrame) -> DataFrame:
    """K1: the last SET or DEL of each key; a SET without a time to live clears it."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "expires_ms"), "seq").alias("w"))
    return last.filter("w.op = 'SET'").select("key", "w.value", "w.expires_ms")


def unexpired(rows: DataFrame, now_ms: int) -> DataFrame:
    """K1, K2: expiry is strict: an entry lives at its very time."""
    return rows.filter(F.col("expires_ms").isNull() | (F.col("expires_ms") >= now_ms))


def remaining_ttl(now_ms: int) -> Column:
    """K3: whole seconds left, at least 1; null without expiry."""
    return F.when(F.col("expires_ms").isNotNull(), F.greatest(F.lit(1), F.floor((F.col("expires_ms") - now_ms) / 1000))).cast("long")


def replayed_expiry(log: DataFrame, replay_ms: int) -> DataFrame:
    """K4: replaying a log starts every time to live anew, from the time of the replay."""
    return log.withColumn("expires_ms", F.when(F.col("ttl_s").isNotNull(), replay_ms + F.col("ttl_s") * 1000))


def expired_items(items: DataFrame, before_ms: int, limit: int = 200) -> DataFrame:
    """K5."""
    return items.filter(F.col("expires_ms") <= before_ms).orderBy("expires_ms", "id").limit(limit)


def fold_in_order(rows: pd.DataFrame, start: float = 0.5) -> float:
    """The fold of one item's events in plain Python, for tests and for the streaming form."""
    value, last = start, None
    for r in rows.sort_values(["ms", "event_id"]).itertuples():
        value *= math.exp(-DECAY * ((r.ms - last) / DAY_MS if last is not None else 0))
        value, last = min(MOST, max(0.0, value + event_effect(r.kind))), r.ms
    return value
