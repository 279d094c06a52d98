from rasterloom.operators import rasters
from rasterloom.plans import registry
from rasterloom.streaming import frames


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    own = rasters.frames(spark, sf_dir).where("anim % 4 = 0")
    for n, part in enumerate(("k < 3", "k >= 3 and k < 5", "k >= 5 or k = 1")):  # the third brings late ones again
        own.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = frames.canvases(stream, 16, 12).writeStream.format("memory").queryName("canvases").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.anim, r.k, r.total, r.mark) for r in spark.table("canvases").collect()}
    want = {(r.anim, r.k, r.total, r.mark) for r in registry.QUERIES["animation_canvas"](spark, sf_dir).where("anim % 4 = 0").collect()}
    assert want and got == want
