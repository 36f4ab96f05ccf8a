"""Calendar order on a stream, batch by batch, against a plain replay."""

import datetime as dt
import random

from fieldcast.streaming import ingest, ordering

DAY0 = dt.date(2000, 1, 1)
SCHEMA = "cell string, ts timestamp, value double"


def at(day, hour=6):
    return dt.datetime.combine(DAY0 + dt.timedelta(days=day), dt.time(hour))


def send(spark, landing, work, rows, wait):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    stream = ingest.event_time(ingest.raw_stream(spark, landing, SCHEMA), delay="1 day")
    ordering.run_ordered(ordering.ordered_days(stream, DAY0, wait), work)


def replay(batches, wait):
    """The same rules on sets: rows, then gaps that the watermark of all rows so far has passed."""
    last, pending, out, late, newest = {}, {}, {}, [], dt.datetime.min
    most = 0
    for rows in batches:
        seen_late = {}
        for cell, ts, value in rows:
            if ts is not None:
                newest = max(newest, ts)
            if None in (cell, ts, value):
                continue
            day = (ts.date() - DAY0).days
            into = seen_late if day <= last.setdefault(cell, -1) else pending.setdefault(cell, {})
            name = (cell, day) if into is seen_late else day
            into[name] = min(value, into.get(name, value))
        late += [(*k, v) for k, v in seen_late.items()]
        for cell, days in pending.items():
            while days and (min(days) == last[cell] + 1 or at(min(days) + wait, 0) <= newest - dt.timedelta(days=1)):
                last[cell] = min(days)
                out[cell, last[cell]] = days.pop(last[cell])
            most = max(most, len(days))
    return out, late, most


def read(spark, work, late=False):
    return sorted((r.cell, (r.time - DAY0).days, r.value) for r in ordering.results(spark, work, late).collect())


def test_shuffled_batches(spark, tmp_path):
    landing, work, rng, wait = str(tmp_path / "in"), str(tmp_path / "work"), random.Random(8), 2
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    batches = []
    try:
        for step in range(5):
            days = [step * 4 + rng.randrange(-5, 6) for _ in range(12)]
            rows = [(rng.choice("ab"), at(d, rng.randrange(24)), float(rng.randrange(50))) for d in days]
            batches.append([*rows, (None, at(0), 1.0), ("a", None, 1.0), ("b", at(1), None)])
            send(spark, landing, work, batches[-1], wait)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    out, late, most = replay(batches, wait)
    assert read(spark, work) == sorted((c, d, v) for (c, d), v in out.items())
    assert read(spark, work, True) == sorted(late) and late
    assert most <= wait + 2  # days between the watermark less the wait and the newest row
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ordering.ROCKSDB


def test_far_late_rows_are_kept_apart(spark, tmp_path):
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        send(spark, landing, work, [("a", at(d), float(d)) for d in (0, 1, 2, 8, 9, 15, 19, 30)], 3)  # several gaps at once
        send(spark, landing, work, [("a", at(1), 9.0), ("a", at(31), 31.0), ("a", at(40), 40.0)], 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert read(spark, work) == [("a", d, float(d)) for d in (0, 1, 2, 8, 9, 15, 19, 30, 31)]
    assert read(spark, work, True) == [("a", 1, 9.0)]
