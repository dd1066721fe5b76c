"""What a line's name is made by stands once in the plan, as its lambdas are worked out wherever they stand."""

from seguelab.functions import text as X
from seguelab.operators import tracklists as T


def test_a_lines_name_is_made_once(spark):
    df = T.description_lines(spark.createDataFrame([("v", "00:45 - Song A - Artist A\n01:00 x\n02:00 Song B")], "video_id string, description string"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("regexp_replace") == len(X.CLEAN) + 1
    assert [(r.position, r.track_raw, r.artist_guess) for r in df.orderBy("position").collect()] == [(1, "Song A - Artist A", "Artist A"), (2, "Song B", "")]
