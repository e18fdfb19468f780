"""Monthly quotas, conflicts, cooldowns and priorities."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidepool.functions import temporal as T
from tidepool.operators import joins, search
from tidepool.sources.generations import own_folder

#: Monthly offers of each plan; None is without limit.
ALLOWANCES = {"free": 1, "pro": 8, "founding_partner": None}


def usage(campaigns: DataFrame, now: Column) -> DataFrame:
    """(venue_id, month, consumed, reserved): published campaigns by local month of their start; one cancelled before it began counts as neither."""
    rows = campaigns.where("published_at IS NOT NULL AND starts_at IS NOT NULL").withColumn("month", T.month_key(F.col("starts_at")))
    begun = (F.col("starts_at") <= now) & (F.col("cancelled_at").isNull() | (F.col("cancelled_at") > F.col("starts_at")))
    ahead = (F.col("starts_at") > now) & F.col("cancelled_at").isNull()
    return rows.groupBy("venue_id", "month").agg(F.count_if(begun).alias("consumed"), F.count_if(ahead).alias("reserved"))


def venue_allowances(claims: DataFrame, allowances: dict[str, int | None] | None = None, partners: str = "") -> DataFrame:
    """(venue_id, allowance, known) of venues with a verified claim, by the best plan among them; null is without limit.

    ``partners``: configured venue ids between commas, whose claims all have the last plan; a list with a bad entry raises.
    """
    from tidepool.functions.text import id_set, plan_name

    allowances = allowances or ALLOWANCES
    order = list(allowances)
    rank = F.array_position(F.array(*map(F.lit, order)), plan_name(F.col("plan")))
    configured = id_set(F.lit(partners))
    ids = F.when(configured["error"].isNull(), configured["ids"]).otherwise(F.raise_error(F.lit("partner venues: not a list of positive ids")).cast("array<bigint>"))
    rank = F.when(F.array_contains(ids, F.col("venue_id")), len(order)).otherwise(rank)
    best = claims.where("status = 'verified'").groupBy("venue_id").agg(F.max(rank).alias("rank"))
    plan = F.element_at(F.array(*map(F.lit, order)), F.col("rank").cast("int"))
    return best.select("venue_id", search.allowance(plan, allowances).alias("allowance"), F.lit(True).alias("known"))


def entitlements(used: DataFrame, claims: DataFrame, allowances: dict[str, int | None] | None = None, partners: str = "") -> DataFrame:
    """(venue_id, month, allowance, remaining); a venue without a verified claim has the first plan's allowance."""
    allowances = allowances or ALLOWANCES
    least = F.lit(next(iter(allowances.values()))).cast("int")
    rows = used.join(venue_allowances(claims, allowances, partners), "venue_id", "left").withColumn("allowance", F.when(F.col("known"), F.col("allowance")).otherwise(least))
    left = F.greatest(F.col("allowance") - F.col("consumed") - F.col("reserved"), F.lit(0).cast("long"))
    return rows.select("venue_id", "month", "allowance", F.when(F.col("allowance").isNotNull(), left).alias("remaining"))


def bucketed(campaigns: DataFrame, state: Column) -> DataFrame:
    """Campaigns with the dashboard's bucket of their state; an unknown state raises."""
    bucket = F.when(state == "live", "active").when(state == "scheduled", "scheduled").when(state == "draft", "drafts").when(state.isin("ended", "cancelled"), "past")
    return campaigns.withColumn("bucket", F.coalesce(bucket, F.raise_error(F.lit("unknown state")).cast("string")))


def first_conflicts(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, conflict): the latest made of the published campaigns that overlap each."""
    c = campaigns.where("published_at IS NOT NULL AND cancelled_at IS NULL").withColumn("until", F.least("ends_at", "ended_at")).where("starts_at < until")
    pairs = joins.overlapping(c, "campaign_id", "venue_id", "starts_at", "until")
    both = pairs.union(pairs.select("b", "a")).toDF("campaign_id", "other")
    made = c.select(F.col("campaign_id").alias("other"), "created_at")
    return both.join(made, "other").groupBy("campaign_id").agg(F.max_by("other", F.struct("created_at", "other")).alias("conflict"))


def cooled(log: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Sends that a cooldown lets through: later than ``seconds`` after the last one let through. Exactly that long after still waits.

    Equal times count once; a row without a time is none. A key's times may be of any number:
    they are dealt by ranges of (key, time), so a long key is many tasks' work. A key that lies
    within one task is folded there. Of all others each piece says where it would leave off
    for each place at which it may be entered, by jump pointers (from a send to the next
    one allowed) that are doubled until they reach the piece's end; a pass over these short
    tables finds where each piece is entered, and pieces are then folded by themselves.
    """
    spark, wait = log.sparkSession, seconds * 1_000_000
    rows = log.select(*keys, F.unix_micros(at).alias("_t")).where("_t IS NOT NULL").distinct()
    own = rows.select(*keys).schema
    dealt = rows.repartitionByRange(*keys, "_t").sortWithinPartitions(*keys, "_t")
    piece = StructType([*own, *StructType.fromDDL("_part int, _seq int, _open boolean, _times array<bigint>, _steps array<bigint>, _exits array<bigint>")])
    folder = own_folder(spark)
    dealt.mapInArrow(lambda batches: _pieces(batches, to_arrow_schema(piece), wait), piece).write.parquet(folder)
    pieces = spark.read.schema(piece).parquet(folder)
    cut = pieces.where("_open")
    places = cut.select(*keys, "_part", "_seq", "_steps", "_exits").repartition(*keys).sortWithinPartitions(*keys, "_part", "_seq")
    entry = StructType.fromDDL("_part int, _seq int, _last bigint")
    entered = places.mapInArrow(lambda batches: _entered(batches, len(keys), to_arrow_schema(entry), wait), entry)
    folded = StructType([*own, *StructType.fromDDL("_times array<bigint>")])
    rest = cut.join(entered, ["_part", "_seq"]).select(*keys, "_times", "_last").mapInArrow(lambda batches: _folded(batches, to_arrow_schema(folded), wait), folded)
    kept = pieces.where("NOT _open").select(*keys, "_times").unionByName(rest)
    return kept.select(*keys, F.explode("_times").alias("_t")).select(*keys, F.timestamp_micros("_t").alias(at))


#: Times of one piece at most.
PIECE = 1 << 16


def _let_through(times: np.ndarray, last: int | None, wait: int) -> np.ndarray:
    """The times that a cooldown lets through after ``last``."""
    onward = np.searchsorted(times, times + wait, "right").tolist()
    i = 0 if last is None else int(np.searchsorted(times, last + wait, "right"))
    kept = []
    while i < len(times):
        kept.append(i)
        i = onward[i]
    return times[kept]


def _exits(times: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, exits): entered after ``last``, the piece leaves off at the exit of the first step beyond last + wait."""
    n = len(times)
    onward = np.searchsorted(times, times + wait, "right")
    jump = np.where(onward == n, np.arange(n), np.minimum(onward, n - 1))
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    # whatever came before is over ``wait`` after the first time
    m = min(n, int(np.searchsorted(times, times[0] + wait, "right")) + 1)
    out = times[jump[:m]]
    last = np.append(out[1:] != out[:-1], True)
    return times[:m][last], out[last]


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, wait: int) -> Iterator[pa.RecordBatch]:
    """Keys that lie within this range, folded, and pieces of those that may go on in others."""
    part, keys, seq = TaskContext.get().partitionId(), schema.names[:-6], 0
    key: tuple | None = None
    held: list[np.ndarray] = []
    size, inner = 0, False
    out: list[dict] = []

    def flush(whole: bool) -> None:
        nonlocal held, size, seq
        if not size:
            return
        times = np.concatenate(held)
        steps, exits = (None, None) if whole else _exits(times, wait)
        out.append(dict(zip(keys, key, strict=True)) | {"_part": part, "_seq": seq, "_open": not whole, "_times": _let_through(times, None, wait) if whole else times, "_steps": steps, "_exits": exits})
        held, size, seq = [], 0, seq + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:-1]:
            differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            new[1:] |= np.asarray(pc.or_(differs, pc.xor(pc.is_null(column[1:]), pc.is_null(column[:-1]))))
        times, cuts = np.asarray(batch.column(batch.num_columns - 1)), [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = tuple(column[i].as_py() for column in batch.columns[:-1])
            if key is None:
                key = own
            elif own != key:
                flush(inner)
                key, inner = own, True
            while i < j:
                take = min(j - i, PIECE - size)
                held.append(times[i : i + take])
                i, size = i + take, size + take
                if size == PIECE and i < j:
                    flush(False)
                    inner = False
            if size == PIECE:
                inner = False
                flush(False)
        if len(out) >= 512:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None:
        flush(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _entered(batches: Iterator[pa.RecordBatch], keys: int, schema: pa.Schema, wait: int) -> Iterator[pa.RecordBatch]:
    """The last send before each piece, over the pieces of each key in order."""
    key: tuple | None = None
    last: int | None = None
    for batch in batches:
        out = []
        for *own, part, seq, steps, exits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is None or tuple(own) != key:
                key, last = tuple(own), None
            out.append({"_part": part, "_seq": seq, "_last": last})
            at = 0 if last is None else bisect.bisect_right(steps, last + wait)
            if at < len(steps):
                last = exits[at]
        yield pa.RecordBatch.from_pylist(out, schema)


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema, wait: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *_, times, last = batch.columns
        kept = [_let_through(np.asarray(t.values), x.as_py(), wait) for t, x in zip(times, last, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.list_(pa.int64()))], schema=schema)


def prioritised(*sources: DataFrame) -> DataFrame:
    """(venue_id, title): of sources (venue_id, title, t, id), a later source wins, within one the later time, then the larger id."""
    rows = None
    for priority, df in enumerate(sources):
        df = df.withColumn("priority", F.lit(priority))
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("venue_id").agg(F.max_by("title", F.struct("priority", "t", "id")).alias("title"))
