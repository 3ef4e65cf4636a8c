import time

import pytest
from pyspark.sql import functions as F

from trackwell.functions import geometry
from trackwell.operators import tracking
from trackwell.plans import catalog
from trackwell.streaming.tracker import track_stream

CORNERS = ", ".join(f"{c} double" for c in geometry.CORNERS)


def _tables(spark):
    """A face far from every box of the scan, whose vector is that of identity 7; others are too unlike, too small or without a vector."""
    dets = spark.createDataFrame([
        (1, 0, 0, 0.0, 0.0, 50.0, 50.0, None), (1, 1, 4, 300.0, 300.0, 350.0, 350.0, [0.6, 0.8]), (1, 2, 4, 500.0, 300.0, 550.0, 350.0, [-1.0, 0.0]),
        (1, 3, 4, 400.0, 0.0, 410.0, 10.0, [0.6, 0.8]), (1, 4, 6, 600.0, 0.0, 650.0, 50.0, None), (2, 5, 0, 300.0, 300.0, 350.0, 350.0, [0.6, 0.8]),
    ], f"video_id long, det_id long, frame_index long, {CORNERS}, embedding array<double>")
    scan = spark.createDataFrame([(1, 3, 0, 0.0, 0.0, 50.0, 50.0)], f"video_id long, cluster_id int, ord long, {CORNERS}")
    known = spark.createDataFrame([(1, 7, [0.0, 1.0]), (1, 3, [0.6, 0.8])], "video_id long, cluster_id int, embedding array<double>")
    return dets, scan, known


def test_a_vector_brings_a_track_back(spark):
    dets, scan, known = _tables(spark)
    seen = lambda out: {(r.video_id, r.cluster_id, r.frame_index) for r in out.collect()}
    without = {(1, 3, f) for f in range(7)}
    assert seen(tracking.track(dets, scan)) == without
    assert seen(tracking.track(dets, scan, known)) == without | {(1, 7, f) for f in range(4, 7)}


def test_a_vector_brings_a_streamed_track_back(spark, tmp_path):
    dets, scan, known = _tables(spark)
    ends = dets.groupBy("video_id").agg(
        F.lit(-1).cast("long").alias("det_id"), F.max("frame_index").alias("frame_index"), *[F.lit(0.0).alias(c) for c in geometry.CORNERS],
        F.lit(None).cast("array<double>").alias("embedding"),
    )
    for n, part in enumerate([dets.where("frame_index < 4"), dets.where("frame_index >= 4"), ends]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in/*")
        out = track_stream(stream, scan, known)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(tracking.track(dets, scan, known))


def test_abandoned_videos_end_and_late_frames_are_told(spark, tmp_path):
    """A pause of over a second ends video 1 with its newest frame; a frame before that one is an error, or left out."""
    dets, scan, known = _tables(spark)

    def streamed(part, n, folder, **how):
        part.coalesce(1).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in/*")
        return track_stream(stream, scan, known, **how).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")

    def arrive(*args, **how):
        streamed(*args, **how).trigger(availableNow=True).start().awaitTermination(60)

    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(tracking.track(dets.where("video_id = 1"), scan, known))
    running = streamed(dets.where("video_id = 1"), 0, tmp_path, idle_ms=1000).trigger(processingTime="500 milliseconds").start()
    try:
        until, got = time.time() + 60, []
        while got != want and time.time() < until:
            time.sleep(1)
            got = key(spark.read.schema(tracking.TRACK_SCHEMA).parquet(f"{tmp_path}/out")) if (tmp_path / "out").exists() else []
    finally:
        running.stop()
    assert got == want
    for how in ("drop", "error"):
        folder = tmp_path / how
        arrive(dets.where("video_id = 1"), 0, folder, late=how)
        late = dets.where("det_id = 2")
        if how == "error":
            with pytest.raises(Exception, match="came after frame"):
                arrive(late, 1, folder, late=how)
        else:
            arrive(late, 1, folder, late=how)
            assert spark.read.parquet(f"{folder}/out").agg(F.max("frame_index")).first()[0] == 5
    with pytest.raises(ValueError):
        track_stream(dets, scan, late="perhaps")


def test_identities_of_all_videos(spark, monkeypatch):
    """Vectors without a video serve every one, up to a checked size."""
    dets, scan, known = _tables(spark)
    own = known.drop("video_id")
    each = dets.select("video_id").distinct().crossJoin(own)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(tracking.track(dets, scan, own)) == key(tracking.track(dets, scan, each))
    monkeypatch.setattr(tracking, "PEOPLE_BYTES", 10)
    with pytest.raises(ValueError):
        tracking.track(dets, scan, own)


def test_embeddings_decide_in_the_query(spark, sf_dir):
    dets, scan, known = catalog._faces(spark, sf_dir)
    assert tracking.track(dets, scan).count() < tracking.track(dets, scan, known).count()


def _plain_tracks(dets, scan, known):
    """The tracker of one video with loops only: dets {frame: [(box, vector)]}, scan [(identity, box)], known {identity: vector}."""
    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0

    tracks, out = {}, []
    for f in range(min(dets), max(dets) + 1):
        if f % 2 == 0:
            for i in [i for i, t in tracks.items() if t["age"] > 15]:
                del tracks[i]
        for t in tracks.values():
            t["axes"] = [(x + v, v, p + 2 * q + 4, q + 2) for x, v, p, q in t["axes"]]
            t["age"] += 1
        if f % 2 == 0:
            boxes = dets.get(f, [])
            order = list(tracks)
            pairs = [(-overlap(b, [a[0] for a in tracks[i]["axes"]]), d, k) for d, (b, _) in enumerate(boxes) for k, i in enumerate(order)]
            used, done = set(), set()
            for s, d, k in sorted(x for x in pairs if -x[0] >= 0.1):
                if d in used or k in done:
                    continue
                used.add(d)
                done.add(k)
                t = tracks[order[k]]
                t["axes"] = [(x + p / (p + 2) * (z - x), v + q / (p + 2) * (z - x), p * (1 - p / (p + 2)), q * (1 - q / (p + 2))) for (x, v, p, q), z in zip(t["axes"], boxes[d][0])]
                t["age"] = 0
            for step in ("scan", "vector"):
                for d, (b, vector) in enumerate(boxes):
                    if d in used or step == "vector" and (vector is None or b[2] - b[0] < 20 or b[3] - b[1] < 20):
                        continue
                    if step == "scan":
                        found = [(overlap(b, o), -n, i) for n, (i, o) in enumerate(scan) if i not in tracks and overlap(b, o) > 0.15]
                    else:
                        found = [(s, -i, i) for i, o in known.items() if i not in tracks and (s := sum(x * y for x, y in zip(vector, o))) > 0.45]
                    if found:
                        used.add(d)
                        tracks[max(found)[2]] = {"axes": [(float(z), 0.0, 10.0, 100.0) for z in b], "age": 0}
        out += [(f, i, *[round(a[0], 4) for a in t["axes"]]) for i, t in tracks.items()]
    return out


def test_tracker_query_against_plain_loops(spark, sf_dir, monkeypatch):
    given = []
    track = tracking.track
    monkeypatch.setattr(tracking, "track", lambda *a: given.append(a) or track(*a))
    got = catalog.QUERIES["tracker_full"](spark, sf_dir).collect()
    box = lambda r: (r.x1, r.y1, r.x2, r.y2)
    dets, scan, known = ({} for _ in range(3))
    for r in sorted(given[0][0].collect(), key=lambda r: r.det_id):
        dets.setdefault(r.video_id, {}).setdefault(r.frame_index, []).append((box(r), r.embedding))
    for r in sorted(given[0][1].collect(), key=lambda r: r.ord):
        scan.setdefault(r.video_id, []).append((r.cluster_id, box(r)))
    for r in sorted(given[0][2].collect()):
        known[r.cluster_id] = r.embedding
    want = sorted((v, *row) for v in dets for row in _plain_tracks(dets[v], scan.get(v, []), known))
    rows = sorted((r.video_id, r.frame_index, r.cluster_id, r.x1, r.y1, r.x2, r.y2) for r in got)
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert all(abs(a - b) < 2e-4 for r, w in zip(rows, want) for a, b in zip(r[3:], w[3:]))
