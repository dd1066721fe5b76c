"""Track lists and chapters meet within a video's row, as the search over sorted rows has them meet."""

from seguelab.operators import relations as R
from seguelab.operators import tracklists as T

SCHEMA = "video_id string, description string, chapters array<struct<start_time:double,title:string>>"


def _videos(spark):
    rows = []
    for v in range(40):
        told = [(17 * v + 11 * k * (1 + v % 3)) % 600 for k in range(v % 5)]
        near = [(t + (7 * k + v) % 13 - 6, f"Chapter {k}") for k, t in enumerate(told)][v % 2 :]
        text = "\n".join(f"{t // 60:02d}:{t % 60:02d} Song {k}" + (f" - Artist {v}" if k % 2 else "") for k, t in enumerate(told))
        rows.append((f"v{v}", text, [(float(max(t, 0)), c) for t, c in near] + ([(None, "no start"), (9.0, "more"), (11.0, "and more")] if v % 7 == 0 else [])))
    return spark.createDataFrame([*rows, (None, "00:01 a song\n00:02 another", [])], SCHEMA)


def test_chapters_are_the_nearest_free_ones(spark):
    videos = _videos(spark)
    lines = {}
    for r in T.description_lines(videos).collect():
        lines.setdefault(r.video_id, []).append((r.position, r.timestamp_s, r.track_raw))
    chapters = {}
    for r in T.watch_lines(videos).collect():
        chapters.setdefault(r.video_id, []).append((r.position, r.timestamp_s, r.track_raw))
    wanted = set()
    for v in range(40):
        mine, theirs = sorted(lines.get(f"v{v}", [])), sorted(chapters.get(f"v{v}", []))
        if len(mine) >= 2:
            picks = R.greedy_matches([m[:2] for m in mine], [c[:2] for c in theirs], 5)
            wanted |= {(f"v{v}", *m, "description" if k is None else "description+chapters", "" if k is None else theirs[k][2], None if k is None else theirs[k][1]) for m, k in zip(mine, picks, strict=True)}
        elif len(theirs) >= 2:
            wanted |= {(f"v{v}", *c, "chapters", c[2], c[1]) for c in theirs}
    out = T.source_rows(videos)
    got = [(r.video_id, r.position, r.timestamp_s, r.track_raw, r.track_source, r.chapter_title, r.chapter_timestamp_s) for r in out.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert {"description", "description+chapters", "chapters"} == {g[4] for g in got}


def test_nothing_is_shuffled(spark):
    plan = T.source_rows(_videos(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan
