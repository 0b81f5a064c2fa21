"""Growth: quotas and order, and a stream with a restart against the batch fold."""

import random

from pyspark.sql import functions as F

from urbanspark.operators import growth


def table(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 11 == 0 else i % 3, rng.randint(0, 9), rng.choice([0.5, 1.0, 1.5]), (1.5, 1.0, 0.2)[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, zone int, context int, dear double, rate double"), rows


def plain(rows, minutes):
    built, out = set(), set()
    draw = lambda key, minute: (key * 7919 + minute * 104_729) % 10_007 / 10_007.0
    for minute in minutes:
        for zone in range(3):
            free = sorted((-draw(i, minute) * (1 + c / 3) * dear, i) for i, z, c, dear, _ in rows if z == zone and i not in built)
            rate = (1.5, 1.0, 0.2)[zone]
            expected = len(free) * growth.START_RATE * rate
            want = int(expected) + (draw(zone, minute) < expected - int(expected))
            for _, i in free[: max(1, want) if rate >= 1 else want]:
                built.add(i)
                out.add((minute, zone, i))
    return out


def test_grown(spark):
    lots, rows = table(spark)
    got = growth.grown(lots, [3, 1, 2, 2]).collect()
    assert {tuple(r) for r in got} == plain(rows, [1, 2, 3]) and len(got) == len({r.id for r in got})


def test_stream_with_a_restart_equals_the_fold(spark, tmp_path):
    lots, rows = table(spark)
    folder, source, state = str(tmp_path / "built"), str(tmp_path / "ticks"), str(tmp_path / "state")
    for run, minutes in enumerate(([1, 2], [4, 2], [5])):
        spark.createDataFrame([(m,) for m in minutes], "minute long").coalesce(1).write.mode("append").parquet(source)
        ticks = spark.readStream.schema("minute long").parquet(source)
        growth.grow_on(ticks, lots, folder).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert growth.built_so_far(spark, folder).select("minute").distinct().count() == (2, 3, 4)[run]
    assert {tuple(r) for r in growth.built_so_far(spark, folder).collect()} == plain(rows, [1, 2, 4, 5])
    last = growth.built_so_far(spark, folder, 2)
    assert last.agg(F.max("minute")).first()[0] == 4
