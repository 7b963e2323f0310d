import shutil
from pathlib import Path

from tessella.operators import telemetry
from tessella.plans.views import Views
from tessella.streaming import telemetry as streaming

DIR = "/root/testdata/sf0.001"


def test_stream_like_batch(spark, tmp_path):
    ticks = Views(spark, DIR).telemetry().select("user_id", "event_id", "pushing", "slow", "ang")
    half = ticks.agg({"event_id": "avg"}).first()[0]
    ticks = ticks.selectExpr("user_id", "event_id", "pushing", "true AS slow", "ang")
    schema = ticks.schema
    ticks.where(f"event_id < {half}").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    ticks.where(f"event_id >= {half}").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    out = []
    seen = Path(tmp_path, "seen")
    seen.mkdir()
    for part in ("a", "b"):
        for f in Path(tmp_path, "in", part).glob("*.parquet"):
            shutil.copy(f, seen / f"{part}-{f.name}")
        found = streaming.stuck(spark.readStream.schema(schema).parquet(str(seen)), limits=(4, 3, 6))
        run = found.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(out) == sorted(map(tuple, telemetry.stuck(ticks, limits=(4, 3, 6)).collect())) and out


def test_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("P2W TLM map=MAP02 x=1 y=2 z=3 lat=51.1 lng=1.1 ang=45 fwd=0 side=1 spd=0.7\nnoise\n")
    out = []
    run = streaming.read_lines(spark, str(tmp_path / "log")).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["map"], r["x"], r["spd"]) for r in out] == [("MAP02", 1.0, 0.7)]
