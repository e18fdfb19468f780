"""Streams that stop, fail and go on: nothing is lost, done twice or kept for ever."""

import datetime as dt
import threading
import uuid

import pytest
from oracle import SF
from pyspark.sql import Row, Window as W, functions as F
from pyspark.sql.types import StructType

from tidepool.operators import accounting
from tidepool.plans import flows as plans
from tidepool.sources.domain import Domain
from tidepool.sources.generations import Files, Generations, Versioned, shared_dir
from tidepool.streaming import flows
from tidepool.streaming.dispatch import Dispatcher


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def race(*jobs):
    """What each job gives, all begun at once."""
    gate, out = threading.Barrier(len(jobs)), [None] * len(jobs)

    def go(i):
        gate.wait()
        out[i] = jobs[i]()

    threads = [threading.Thread(target=go, args=(i,)) for i in range(len(jobs))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_a_file_is_put_once(spark, folder):
    for k in range(5):
        files = [Files(spark.newSession(), folder) for _ in range(6)]
        done = race(*[lambda f=f, i=i: f.put_once(f"n{k}", f"of {i}") for i, f in enumerate(files)])
        assert sum(done) == 1 and Files(spark, folder).read(f"n{k}") == f"of {done.index(True)}"
    assert Files(spark, folder).names() == [f"n{k}" for k in range(5)]


def test_of_two_writers_with_one_token_one_wins(spark, folder):
    rows = spark.range(3).withColumn("by", F.lit("first"))
    assert Versioned(spark, folder).replace(rows, 0) == 1
    writers = [Versioned(s, folder) for s in (spark.newSession(), spark.newSession())]
    tokens = [w.read()[1] for w in writers]
    assert tokens == [1, 1]
    done = race(*[lambda w=w, i=i: w.replace(w.read()[0].withColumn("by", F.lit(f"writer {i}")), 1) for i, w in enumerate(writers)])
    assert sorted(done, key=str) == [2, None]
    now, token = Versioned(spark, folder).read()
    assert token == 2 and {r["by"] for r in now.collect()} == {f"writer {done.index(2)}"}
    assert writers[done.index(None)].replace(rows, 1) is None


def test_older_generations_are_refused_after_a_restart(spark, folder):
    assert Generations(spark, folder).commit(3, spark.range(3))
    again = Generations(spark.newSession(), folder)
    assert not again.commit(2, spark.range(9)) and not again.commit(3, spark.range(9))
    assert again.read().count() == 3 and again.numbers() == [3]
    staged = again.stage()
    spark.range(99).write.parquet(staged)  # a writer that died before its manifest
    assert Generations(spark, folder).read().count() == 3


def test_a_failing_batch_leaves_the_last_good_one(spark, folder):
    d = Domain(spark, SF)

    def poll(k, rows):
        spark.createDataFrame(rows, "id long, expires_at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    t = dt.datetime(2024, 1, 1)
    feed = lambda: spark.readStream.schema("id long, expires_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    valid = F.col("id") > 0
    poll(0, [(1, t), (2, t + dt.timedelta(hours=1))])
    assert flows.replaced(d, feed(), f"{folder}/feed", valid, "append").count() == 2
    poll(1, [(3, t), (-1, t)])
    for _ in range(2):  # a restart meets the same batch again
        with pytest.raises(Exception, match="batch 1"):
            flows.replaced(d, feed(), f"{folder}/feed", valid, "append")
        kept = flows.last_good(Generations(spark, f"{folder}/feed/out"), F.lit(t), "expires_at")
        assert [r["id"] for r in kept.collect()] == [2]  # 1 has run out


def parts_of_events(spark, folder):
    """The events of the smallest table in four files by time, put into a folder one after another."""
    events = Domain(spark, SF).raw("events").orderBy("ts")
    quarters = events.withColumn("q", F.ntile(4).over(W.orderBy("ts"))).groupBy("q").agg(F.max("ts").alias("t")).orderBy("q")
    cuts = [r["t"] for r in quarters.collect()]
    low = None
    for high in cuts:
        part = events.where(F.col("ts") <= high)
        part = part if low is None else part.where(F.col("ts") > low)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        low = high
        yield events.where(F.col("ts") <= high)


def test_cooldown_goes_on_where_it_stopped(spark, folder):
    d, keys = Domain(spark, SF), ["user_id", "venue_id", "channel"]
    for so_far in parts_of_events(spark, folder):
        sent = d.stream_of_sends(spark.readStream.schema(so_far.schema).parquet(f"{folder}/in"))
        got = flows.cooled(d, sent, keys, "sent_at", 3 * 3600, f"{folder}/cool")
        want = accounting.cooled(d.stream_of_sends(so_far), keys, "sent_at", 3 * 3600)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # what is kept of keys: those whose cooldown isn't over
    state = spark.read.format("statestore").option("path", f"{folder}/cool/state").option("stateVarName", "last").load().count()
    newest = want.agg(F.max("sent_at")).first()[0]
    assert state == want.where(F.col("sent_at") > F.lit(newest - dt.timedelta(hours=3))).count() < want.select(*keys).distinct().count() / 5


def test_state_with_time_to_live_goes_on_where_it_stopped(spark, folder):
    d = Domain(spark, SF)
    for so_far in parts_of_events(spark, folder):
        got = flows.alive(d, spark.readStream.schema(so_far.schema).parquet(f"{folder}/in"), "user_id", "ts", 6 * 3600, f"{folder}/alive")
        newest = so_far.agg(F.max("ts")).first()[0]
        want = so_far.groupBy("user_id").agg(F.max("ts").alias("last_seen")).where(F.col("last_seen") > F.lit(newest - dt.timedelta(hours=6)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_is_asked_for_by_bucket_not_by_key():
    """Calls of the state store don't grow with keys whose cooldown is over by the end of their own batch."""
    calls, stored, timers = [], {}, []

    class Fake:
        def getMapState(self, *_):
            return self

        def iterator(self):
            calls.append("iterator")
            return iter([(k, v) for k, v in stored.items()])

        def updateValue(self, key, value):
            calls.append("update")
            stored[key] = value

        def listTimers(self):
            calls.append("timers")
            return iter(timers)

        def registerTimer(self, at):
            calls.append("timer")
            timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 0

    cool = flows._Cooldown(StructType().add("k", "long"), 10_000)
    cool.init(Fake())
    rows = [Row(k=k, _at=k * 1000, _watermark=k) for k in range(1000)] + [Row(k=5, _at=5001, _watermark=5), Row(k=5, _at=20_000, _watermark=20)]
    got = [(r["k"], r["_at"]) for r in cool.handleInputRows((0,), iter(rows), Fake())]
    assert sorted(got) == sorted([(k, k * 1000) for k in range(1000)] + [(5, 20_000)])
    assert len(calls) < 20 and sorted(stored) == [(k,) for k in range(990, 1000)] and timers == [(990_000 + 10_000) // 1000 + 1]


def test_newest_generation_of_a_key_goes_on_where_it_stopped(spark, folder):
    d, rows = Domain(spark, SF), []
    for k, batch in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 4, "stale"), (2, 2, "c")], [(1, 6, "d"), (3, 1, "e")]]):
        rows += batch
        spark.createDataFrame(batch, "key long, generation long, value string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = flows.fresh(d, spark.readStream.schema("key long, generation long, value string").parquet(f"{folder}/in"), "key", "generation", f"{folder}/fresh")
        assert sorted(map(tuple, got.select("key", "generation", "value").collect())) == sorted(max((r for r in rows if r[0] == key), key=lambda r: r[1]) for key in {r[0] for r in rows})
        assert len(Generations(spark, f"{folder}/fresh/out").numbers()) <= 2


class Killed(Exception):
    pass


def test_dispatch_that_is_killed_anywhere(spark, folder, monkeypatch):
    """Runs die before their manifest, before anything is delivered, and with half of it delivered."""
    d = Domain(spark, SF)
    inbox: dict[str, tuple] = {}
    dying = {"publish": 1, "before": 1, "half": 3}
    runs = iter(range(99))

    def deliver(digests):
        run = next(runs)
        rows = digests.orderBy("message_id").collect()
        for i, r in enumerate(rows):
            if dying.get("before") == run or dying.get("half") == run and i == len(rows) // 2:
                raise Killed(run)
            assert inbox.setdefault(r["message_id"], tuple(r)) == tuple(r)  # a message that comes again is the same

    def dispatcher():
        return Dispatcher(d.alerts(), d.users(), plans.offered(d), d.overrides(), folder, deliver=deliver, site="host.test")

    publish, calls = Generations.publish, iter(range(99))

    def dies(self, *args, **notes):
        if next(calls) == dying["publish"]:
            raise Killed
        return publish(self, *args, **notes)

    monkeypatch.setattr(Generations, "publish", dies)
    hours = [(dt.datetime(1998, 6, 15, 20) + dt.timedelta(hours=k),) for k in range(4)]
    spark.createDataFrame(hours, "at timestamp").coalesce(1).write.parquet(f"{folder}-clock")
    clock = lambda: spark.readStream.schema("at timestamp").parquet(f"{folder}-clock")
    deaths = 0
    for _ in range(9):
        try:
            dispatcher().follow(clock())
            break
        except Exception as error:
            assert "Killed" in str(error)
            deaths += 1
    assert deaths == 3
    whole = Dispatcher(d.alerts(), d.users(), plans.offered(d), d.overrides(), f"{folder}-whole")
    whole.follow(clock())
    log = sorted(map(tuple, dispatcher().log().collect()))
    assert log == sorted(map(tuple, whole.log().collect())) and log
    # each send was in exactly one message, and no key came twice within the cooldown
    assert sum(m[5] for m in inbox.values()) == len(log)
    last: dict[tuple, dt.datetime] = {}
    for user, channel, venue, at in sorted(log, key=lambda r: r[3]):
        assert (user, channel, venue) not in last or at - last[user, channel, venue] > dt.timedelta(hours=3)
        last[user, channel, venue] = at
    assert not dispatcher().run(dt.datetime(1998, 6, 15, 19, tzinfo=dt.UTC))  # the clock doesn't go back
    assert all(m[4].endswith(". host.test") for m in inbox.values() if m[1] == "text")


def test_dispatch_prunes_its_log(spark, folder):
    d = Domain(spark, SF)
    cleaned = []
    runs = Dispatcher(d.alerts(), d.users(), plans.offered(d), d.overrides(), folder, maintain=cleaned.append)
    first = dt.datetime(1998, 6, 15, 22, tzinfo=dt.UTC)
    for days in (0, 1, 8):
        assert runs.run(first + dt.timedelta(days=days))
    assert runs.runs.numbers() == [int((first + dt.timedelta(days=days)).timestamp()) for days in (1, 8)]
    assert len(cleaned) == 3
