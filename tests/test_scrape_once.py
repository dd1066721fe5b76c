"""A channel's listing is read once, however many steps of the chain use it."""

from seguelab.operators import caches as C


def test_the_listing_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            read.add(len(pdf))
            yield pdf

    listing = spark.createDataFrame([(f"v{i}", "a video", "") for i in range(6)], "video_id string, video_title string, video_url string").mapInPandas(counted, "video_id string, video_title string, video_url string")
    metadata = spark.createDataFrame([(f"v{i}", "00:01 Song A\n01:00 Song B" if i != 5 else "00:01 Song A") for i in range(6)], "video_id string, description string")
    sign = C.source_signature(C.F.lit("u"), C.F.lit("good"), C.F.lit("mine"))
    cache = spark.createDataFrame([("v0", 1, "kept 1"), ("v0", 2, "kept 2"), ("v1", 1, "kept alone")], "video_id string, position int, track_raw string").withColumn("source_signature", sign)
    rows, _, counts = C.scrape_channel(listing, metadata, cache, "u", "good", "mine")
    got = sorted((r.video_id, r.position, r.track_raw) for r in rows.collect())
    assert got == [("v0", 1, "kept 1"), ("v0", 2, "kept 2")] + [(f"v{i}", k + 1, f"Song {'AB'[k]}") for i in (2, 3, 4) for k in (0, 1)]
    assert counts.first().asDict() == {"videos_scanned": 6, "videos_with_tracklist": 4, "tracks_parsed": 8, "videos_skipped": 2, "videos_from_cache": 2}
    assert read.value == 6
