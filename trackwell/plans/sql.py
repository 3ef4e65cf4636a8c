"""DuckDB SQL for the registered queries, over the base tables."""

from __future__ import annotations

from trackwell.operators.selection import PHASES, STEPS
from trackwell.plans.views import ANCHORS, BOXES, OBS, PROGRESS, RECORDED, VIDEOS

_B, _O = f"WITH boxes AS ({BOXES})", f"WITH obs AS ({OBS})"


def _iou(a: str, b: str, plus: str = "") -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1){plus})"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1){plus})"
    area = lambda r: f"(({r}.x2 - {r}.x1{plus}) * ({r}.y2 - {r}.y1{plus}))"
    return f"(CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0 ELSE {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) END)"


_V = f"WITH videos AS ({VIDEOS})"
_P = "WITH progress AS (" + PROGRESS.replace("element_at(PHASES, CAST(event_id % 10 + 1 AS INT))", "[" + ", ".join(f"'{p}'" for p in (*(p for p, _ in PHASES), "done", "idle")) + "][event_id % 10 + 1]") + ")"
_PAIRS = f"{_B} SELECT a.frame_index, a.det_id AS det_a, b.det_id AS det_b, round({_iou('a', 'b')}, 6) AS iou FROM boxes a JOIN boxes b ON a.frame_index = b.frame_index AND a.det_id < b.det_id WHERE {_iou('a', 'b')} > 0"
_STEPS = f"""{_O}, p AS (SELECT b.frame_index, a.det_id AS det_a, b.det_id AS det_b, {_iou('a', 'b')} AS iou
  FROM obs a JOIN obs b ON b.frame_index = a.frame_index + 2 WHERE a.observed AND b.observed)"""
_GREEDY = f"""{_STEPS}, l AS (SELECT frame_index, list([{{l: det_a, r: det_b, iou: iou}}] ORDER BY iou DESC, det_a, det_b) AS ps FROM p WHERE iou >= 0.1 GROUP BY frame_index),
g AS (SELECT frame_index, unnest(list_reduce(ps, lambda done, n: CASE WHEN len(list_filter(done, lambda m: m.l = n[1].l OR m.r = n[1].r)) > 0 THEN done ELSE list_concat(done, n) END)) AS m FROM l)"""
_TURNS = f"""WITH RECURSIVE obs AS ({OBS}), p AS (SELECT b.frame_index, a.det_id AS det_a, b.det_id AS det_b, {_iou('a', 'b')} AS iou
  FROM obs a JOIN obs b ON b.frame_index = a.frame_index + 2 WHERE a.observed AND b.observed),
c AS (SELECT * FROM p WHERE iou > 0.3),
n AS (SELECT frame_index, det_a, row_number() OVER (PARTITION BY frame_index ORDER BY det_a) AS turn FROM (SELECT DISTINCT frame_index, det_a FROM c)),
t AS (SELECT n.frame_index, n.turn, n.det_a, list({{b: det_b, iou: iou}} ORDER BY iou DESC, det_b) AS cs FROM n JOIN c USING (frame_index, det_a) GROUP BY ALL),
s AS (SELECT frame_index, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS det_a, CAST(NULL AS BIGINT) AS det_b, CAST(NULL AS DOUBLE) AS iou, CAST([] AS BIGINT[]) AS used FROM t WHERE turn = 1
  UNION ALL
  SELECT x.frame_index, x.turn, x.det_a, x.f.b, x.f.iou, CASE WHEN x.f IS NULL THEN x.used ELSE list_append(x.used, x.f.b) END
  FROM (SELECT t.frame_index, t.turn, t.det_a, s.used, list_filter(t.cs, lambda c: NOT list_contains(s.used, c.b))[1] AS f FROM s JOIN t ON t.frame_index = s.frame_index AND t.turn = s.turn + 1) x),
m AS (SELECT frame_index, det_a, det_b, iou FROM s WHERE det_b IS NOT NULL)"""
_CENTROIDS = """e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"""
_LABELLED = f"{_B}, l AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY x1, det_id) - 1 AS cluster_id FROM boxes)"
_COLS = "CAST(floor(640 / stride) AS BIGINT)"
_PERCENT = "".join(f" WHEN '{p}' THEN {sum(w for _, w in PHASES[:i])} + phase_percent * {w} / 100" for i, (p, w) in enumerate(PHASES[:5]))

SQL: dict[str, str] = {
    "nms_per_frame": f"""{_B}, l AS (SELECT frame_index, list([{{d: det_id, c: confidence, x1: x1, y1: y1, x2: x2, y2: y2}}] ORDER BY confidence DESC, det_id) AS bs FROM boxes GROUP BY frame_index),
k AS (SELECT frame_index, unnest(list_reduce(bs, lambda kept, n: CASE WHEN len(list_filter(kept, lambda k: {_iou('k', 'n[1]', ' + 1')} > 0.35)) > 0 THEN kept ELSE list_concat(kept, n) END)) AS b FROM l)
SELECT frame_index, b.d AS det_id, b.c AS confidence FROM k""",
    "iou_pairs": _PAIRS,
    "iou_pairs_grid": _PAIRS,
    "shape_filter": f"{_B} SELECT det_id, frame_index FROM boxes WHERE x2 - x1 >= 10 AND y2 - y1 >= 10 AND x2 - x1 > (y2 - y1) * CAST(0.4 AS DOUBLE) AND x2 - x1 < (y2 - y1) * CAST(2.5 AS DOUBLE)",
    "expand_box": f"""{_B}, e AS (SELECT *, (x2 - x1) * CAST(0.2 AS DOUBLE) AS dx, (y2 - y1) * CAST(0.2 AS DOUBLE) AS dy FROM boxes)
SELECT det_id, greatest(0.0::DOUBLE, floor(x1 - dx + 0.5)) AS x1, greatest(0.0::DOUBLE, floor(y1 - dy + 0.5)) AS y1,
       least(640.0::DOUBLE, floor(x2 + dx + 0.5)) AS x2, least(480.0::DOUBLE, floor(y2 + dy + 0.5)) AS y2 FROM e""",
    "anchor_decode": f"""WITH anchors AS ({ANCHORS}), s AS (SELECT *, sqrt(greatest(0, least(1, cls)) * greatest(0, least(1, obj))) AS confidence,
  (cell % {_COLS} + dx) * stride AS cx, (cell // {_COLS} + dy) * stride AS cy, exp(dw) * stride AS w, exp(dh) * stride AS h FROM anchors)
SELECT anchor_id, frame_index, round(confidence, 4) AS confidence, round(greatest(0, least(640, cx - w / 2)), 4) AS x1, round(greatest(0, least(640, cy - h / 2)), 4) AS y1,
       round(greatest(0, least(640, cx + w / 2)), 4) AS x2, round(greatest(0, least(640, cy + h / 2)), 4) AS y2 FROM s WHERE confidence >= 0.3""",
    "topk_per_frame": f"{_B} SELECT * FROM (SELECT frame_index, det_id, row_number() OVER (PARTITION BY frame_index ORDER BY confidence DESC, det_id) AS rank FROM boxes) WHERE rank <= 3",
    "l2_normalize": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(1.0::DOUBLE, 6) AS unit FROM n""",
    "cosine_pairs": """SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2""",
    "centroids": f"WITH {_CENTROIDS} SELECT label, CAST(i - 1 AS BIGINT) AS i, round(m / n, 6) AS v FROM m JOIN n USING (label)",
    "identity_match_top1": f"""WITH {_CENTROIDS}, k AS (SELECT label AS id, list(m / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label),
s AS (SELECT vec_id, id, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS sim FROM embeddings, k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, id) AS n FROM s) SELECT vec_id, id, round(sim, 5) AS sim FROM r WHERE n = 1 AND sim > 0.2""",
    "position_identity": f"{_LABELLED} SELECT det_id, frame_index, cluster_id FROM l",
    "identity_summary": f"""{_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, det_id) AS n, count(*) OVER (PARTITION BY cluster_id) AS c FROM l)
SELECT cluster_id, c AS face_count, det_id AS representative_det_id, confidence AS best_confidence FROM r WHERE n = 1""",
    "greedy_match": f"{_GREEDY} SELECT frame_index, m.l AS det_a, m.r AS det_b, round(m.iou, 6) AS iou FROM g",
    "seq_match_prev_next": f"{_TURNS} SELECT frame_index, det_a, det_b, round(iou, 6) AS iou FROM m",
    "interpolate_boxes": f"{_TURNS} SELECT det_a, det_b, " + ", ".join(f"round(a.{c} + (b.{c} - a.{c}) * 0.5, 6) AS {c}" for c in ("x1", "y1", "x2", "y2", "confidence")) + " FROM m JOIN obs a ON a.det_id = det_a JOIN obs b ON b.det_id = det_b",
    "nearest_sample_match": f"""{_O}, t AS (SELECT DISTINCT CAST(floor(frame_index / 250) AS BIGINT) AS video, frame_index, frame_index / 30.0::DOUBLE AS ts FROM obs),
r AS (SELECT t.video, t.ts, s.ts AS sample_ts, row_number() OVER (PARTITION BY t.video, t.frame_index ORDER BY abs(t.frame_index - s.frame_index), s.frame_index) AS n
      FROM t JOIN t s ON s.video = t.video AND s.frame_index % 30 = 0) SELECT video, ts, sample_ts FROM r WHERE n = 1""",
    "sample_timestamps": f"""{_V}, k AS (SELECT id, duration AS d, unnest(range(CAST(ceil(duration) AS BIGINT))) AS k FROM videos)
SELECT id, round(k + 0.1::DOUBLE, 6) AS ts FROM k WHERE k + 0.1::DOUBLE < d - 0.1::DOUBLE AND k < ceil(d - 0.2::DOUBLE - 1e-9)""",
    "frame_timestamps": f"""{_V}, k AS (SELECT id, duration, unnest(range(CAST(ceil(duration * fps) AS BIGINT))) AS frame_index FROM videos)
SELECT id, frame_index, round(least(frame_index / 30.0::DOUBLE, duration - 0.001::DOUBLE), 6) AS ts FROM k""",
    "frame_stride": f"{_B} SELECT frame_index, count(*) AS n FROM boxes WHERE frame_index % 2 = 0 GROUP BY frame_index",
    "segments": f"{_B} SELECT CAST(floor(frame_index / 300) AS BIGINT) AS segment, min(frame_index + 1) AS first, max(frame_index + 1) AS last FROM boxes GROUP BY 1",
    "kalman_batch": f"""WITH RECURSIVE obs AS ({OBS}), z AS (SELECT obj_id, a.axis, frame_index, CASE WHEN observed AND frame_index % 2 = 0 THEN a.z END AS z
  FROM (SELECT *, unnest([{', '.join(f"{{axis: '{c}', z: {c}}}" for c in ("x1", "y1", "x2", "y2"))}]) AS a FROM obs)),
k AS (SELECT obj_id, axis, frame_index, z AS x, 0.0::DOUBLE AS v, 10.0::DOUBLE AS p, 100.0::DOUBLE AS q FROM z WHERE (obj_id, frame_index) IN (SELECT (obj_id, min(frame_index)) FROM z WHERE z IS NOT NULL GROUP BY obj_id)
  UNION ALL
  SELECT obj_id, axis, f, CASE WHEN z IS NULL THEN xp ELSE xp + pp / (pp + 2) * (z - xp) END, CASE WHEN z IS NULL THEN v ELSE v + qp / (pp + 2) * (z - xp) END,
         CASE WHEN z IS NULL THEN pp ELSE pp * (1 - pp / (pp + 2)) END, CASE WHEN z IS NULL THEN qp ELSE qp * (1 - qp / (pp + 2)) END
  FROM (SELECT k.obj_id, k.axis, z.frame_index AS f, z.z, k.x + k.v AS xp, k.v, k.p + 2 * k.q + 4 AS pp, k.q + 2 AS qp FROM k JOIN z ON z.obj_id = k.obj_id AND z.axis = k.axis AND z.frame_index = k.frame_index + 1))
SELECT obj_id, axis, frame_index, round(x, 4) AS x, round(v, 4) AS v, round(p, 4) AS p, round(q, 4) AS q FROM k""",
    "track_expiry": f"""{_O}, s AS (SELECT obj_id, frame_index, frame_index - max(CASE WHEN observed AND frame_index % 2 = 0 THEN frame_index END) OVER (PARTITION BY obj_id ORDER BY frame_index) AS since FROM obs)
SELECT obj_id, frame_index, since, since <= 17 AS alive FROM s WHERE since IS NOT NULL""",
    "selection_semi": f"{_LABELLED} SELECT det_id, cluster_id FROM l WHERE cluster_id IN (0, 2, 4, 6)",
    "unmatched_anti": f"{_GREEDY} SELECT det_id, frame_index FROM obs WHERE observed AND det_id NOT IN (SELECT m.r FROM g)",
    "style_coalesce": f"{_LABELLED} SELECT det_id, cluster_id, CASE cluster_id WHEN 1 THEN 'eye-bar' WHEN 3 THEN 'black-box' ELSE 'pixelate' END AS style FROM l",
    "redaction_geometry": f"""{_B}, c AS (SELECT det_id, ['pixelate', 'eye-bar', 'eye-bar-fine', 'black-box'][det_id % 4 + 1] AS style,
  greatest(0, least(640, x1)) AS x, greatest(0, least(480, y1)) AS y, greatest(0, least(640, x2)) - greatest(0, least(640, x1)) AS w, greatest(0, least(480, y2)) - greatest(0, least(480, y1)) AS h FROM boxes),
r AS (SELECT *, CASE style WHEN 'eye-bar' THEN greatest(10, h * 0.2::DOUBLE) WHEN 'eye-bar-fine' THEN greatest(6, h * 0.12::DOUBLE) ELSE floor(h + 0.5) END AS rh FROM c WHERE w >= 2 AND h >= 2)
SELECT det_id, style, round(CASE style WHEN 'eye-bar' THEN x + w * 0.05::DOUBLE WHEN 'eye-bar-fine' THEN x + w * 0.075::DOUBLE ELSE floor(x + 0.5) END, 6) AS rx,
       round(CASE style WHEN 'eye-bar' THEN y + h * 0.22::DOUBLE WHEN 'eye-bar-fine' THEN y + h * 0.28::DOUBLE ELSE floor(y + 0.5) END, 6) AS ry,
       round(CASE style WHEN 'eye-bar' THEN w * 0.9::DOUBLE WHEN 'eye-bar-fine' THEN w * 0.85::DOUBLE ELSE floor(w + 0.5) END, 6) AS rw, round(rh, 6) AS rh,
       round(CASE style WHEN 'eye-bar' THEN least(4, rh / 2) WHEN 'eye-bar-fine' THEN least(3, rh / 2) ELSE 0 END, 6)::DOUBLE AS radius FROM r""",
    "mosaic_blocks": """SELECT event_id % 100 // 15 AS bx, event_id // 100 // 15 AS "by", round(avg(event_id * 7 % 256), 6) AS r, round(avg((event_id * 13 + user_id) % 256), 6) AS g, count(*) AS n FROM events GROUP BY 1, 2""",
    "toggle_selection": "SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1",
    "latest_override": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "progress_percent": f"""{_P} SELECT event_id, phase, phase_percent, least(100, floor(CASE phase{_PERCENT} ELSE 80 END + 0.5))::DOUBLE AS overall_percent FROM progress""",
    "names": r"""SELECT page_id, 'frame_' || printf('%04d', page_id + 1) || '.jpg' AS frame, regexp_replace(coalesce(url, 'video.mp4'), '\.[A-Za-z0-9_]+$', '_blurred.mp4') AS output, replace(url, '-', ' ') AS label FROM pages""",
    "letterbox_params": f"""{_B}, s AS (SELECT det_id, x2 - x1 AS w, y2 - y1 AS h, least(640 / (x2 - x1), 640 / (y2 - y1)) AS scale FROM boxes),
n AS (SELECT det_id, scale, floor(w * scale + 0.5) AS nw, floor(h * scale + 0.5) AS nh FROM s)
SELECT det_id, round(scale, 6) AS scale, nw AS new_width, nh AS new_height, CAST(floor((640 - nw) / 2) AS BIGINT) AS pad_x, CAST(floor((640 - nh) / 2) AS BIGINT) AS pad_y FROM n""",
    "actual_fps": f"""{_B} SELECT frame_index % 7 AS video, count(*) AS frames, count(*) FILTER (det_id % 10 = 0) AS keyframes,
  round(CASE WHEN max(frame_index % 7) > 0 THEN count(*) / (max(frame_index % 7) * 3.5::DOUBLE) END, 6) AS fps FROM boxes GROUP BY 1""",
    "detector_tail": f"""WITH anchors AS ({ANCHORS}), s AS (SELECT *, sqrt(greatest(0, least(1, cls)) * greatest(0, least(1, obj))) AS confidence,
  (cell % {_COLS} + dx) * stride AS cx, (cell // {_COLS} + dy) * stride AS cy, exp(dw) * stride AS w, exp(dh) * stride AS h FROM anchors),
boxes AS (SELECT anchor_id AS det_id, frame_index, confidence, greatest(0, least(640, cx - w / 2)) AS x1, greatest(0, least(640, cy - h / 2)) AS y1,
  greatest(0, least(640, cx + w / 2)) AS x2, greatest(0, least(640, cy + h / 2)) AS y2 FROM s WHERE confidence >= 0.3),
l AS (SELECT frame_index, list([{{d: det_id, c: confidence, x1: x1, y1: y1, x2: x2, y2: y2}}] ORDER BY confidence DESC, det_id) AS bs FROM boxes GROUP BY frame_index),
k AS (SELECT frame_index, unnest(list_reduce(bs, lambda kept, n: CASE WHEN len(list_filter(kept, lambda k: {_iou('k', 'n[1]', ' + 1')} > 0.35)) > 0 THEN kept ELSE list_concat(kept, n) END)) AS b FROM l),
o AS (SELECT frame_index, b.d AS det_id, row_number() OVER (PARTITION BY frame_index ORDER BY b.c DESC, b.d) AS rank FROM k
  WHERE b.x2 - b.x1 >= 10 AND b.y2 - b.y1 >= 10 AND b.x2 - b.x1 > (b.y2 - b.y1) * CAST(0.4 AS DOUBLE) AND b.x2 - b.x1 < (b.y2 - b.y1) * CAST(2.5 AS DOUBLE))
SELECT * FROM o WHERE rank <= 20""",
    "head_union": f"""WITH anchors AS ({ANCHORS}) SELECT frame_index, CAST(CASE stride WHEN 8 THEN 0 WHEN 16 THEN 1 ELSE 2 END AS BIGINT) AS head_ord, count(*) AS n, CAST(min(cell) AS BIGINT) AS first_cell FROM anchors GROUP BY 1, 2""",
    "frame_lookup": f"{_B} SELECT det_id, frame_index, round(frame_index / 30.0::DOUBLE, 6) AS frame_ts, 640 AS frame_width, 480 AS frame_height FROM boxes WHERE frame_index % 7 <> 3",
    "embedding_filter": f"""{_B}, e AS (SELECT *, (x2 - x1) * CAST(0.2 AS DOUBLE) AS dx, (y2 - y1) * CAST(0.2 AS DOUBLE) AS dy FROM boxes JOIN embeddings ON vec_id = det_id)
SELECT det_id, frame_index FROM e WHERE least(640, floor(x2 + dx + 0.5)) - greatest(0, floor(x1 - dx + 0.5)) >= 28 AND least(480, floor(y2 + dy + 0.5)) - greatest(0, floor(y1 - dy + 0.5)) >= 28""",
    "nearest_identity": f"""{_O}, t AS (SELECT *, CAST(floor(frame_index / 250) AS BIGINT) AS video FROM obs),
f AS (SELECT DISTINCT video, frame_index FROM t),
r AS (SELECT f.video, f.frame_index, s.frame_index AS sample, row_number() OVER (PARTITION BY f.video, f.frame_index ORDER BY abs(f.frame_index - s.frame_index), s.frame_index) AS n
      FROM f JOIN f s ON s.video = f.video AND s.frame_index % 30 = 0),
p AS (SELECT a.video, a.det_id, CAST(b.obj_id AS BIGINT) AS cluster_id, {_iou('a', 'b')} AS iou, b.det_id AS d FROM t a JOIN r ON r.video = a.video AND r.frame_index = a.frame_index AND r.n = 1
      JOIN t b ON b.video = a.video AND b.frame_index = r.sample WHERE a.observed AND b.obj_id <> 5),
o AS (SELECT *, row_number() OVER (PARTITION BY video, det_id ORDER BY iou DESC, d) AS n FROM p WHERE iou > 0.3)
SELECT video, det_id, cluster_id, round(iou, 6) AS iou FROM o WHERE n = 1""",
    "bracketing_frames": f"""{_O}, f AS (SELECT frame_index, obj_id, CAST(floor(frame_index / 250) AS BIGINT) AS video FROM obs WHERE observed),
b AS (SELECT *, max(CASE WHEN frame_index % 4 = 0 THEN frame_index END) OVER (PARTITION BY obj_id, video ORDER BY frame_index) AS prev_index,
  min(CASE WHEN frame_index % 4 = 0 THEN frame_index END) OVER (PARTITION BY obj_id, video ORDER BY frame_index DESC) AS next_index FROM f)
SELECT *, round(CASE WHEN next_index > prev_index THEN (frame_index - prev_index) / (next_index - prev_index)::DOUBLE WHEN next_index = prev_index THEN 0 END, 6) AS t FROM b""",
    "interpolate_detections": f"""{_TURNS}, q AS (SELECT *, (det_a % 3 + 1) / 4.0::DOUBLE AS t FROM m) SELECT det_a, det_b, """
    + ", ".join(f"round(a.{c} + (b.{c} - a.{c}) * t, 6) AS {c}" for c in ("x1", "y1", "x2", "y2", "confidence"))
    + ", " + ", ".join(f"CASE WHEN t < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in ("frame_index", "obj_id")) + " FROM q JOIN obs a ON a.det_id = det_a JOIN obs b ON b.det_id = det_b",
    "largest_frame_faces": f"""{_O}, n AS (SELECT frame_index, count(*) AS n FROM obs WHERE observed GROUP BY 1) SELECT CAST(floor(frame_index / 25) AS BIGINT) AS video, max(n) AS most FROM n GROUP BY 1""",
    "identity_previews": f"""{_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, det_id) AS n FROM l),
p AS (SELECT cluster_id, det_id, floor(greatest(0, x1)) AS x, floor(greatest(0, y1)) AS y, least(640, ceil(x2)) AS x9, least(480, ceil(y2)) AS y9, det_id % 3 <> 0 AS known FROM r WHERE n = 1)
SELECT cluster_id, det_id AS representative_det_id, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN x9 - x END AS w, CASE WHEN ok THEN y9 - y END AS h
FROM (SELECT *, known AND x9 > x AND y9 > y AS ok FROM p)""",
    "expected_frames": f"{_V} SELECT id, CAST(ceil(duration * fps) AS BIGINT) AS expected_frames FROM videos",
    "frame_ordinals": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index FROM events",
    "sampled_progress": f"{_P} SELECT event_id, phase FROM progress WHERE event_id % 5 = 0",
    "running_faces": f"""{_O}, n AS (SELECT frame_index, count(*) AS n, CAST(floor(frame_index / 250) AS BIGINT) AS video FROM obs WHERE observed GROUP BY 1)
SELECT *, CAST(sum(n) OVER (PARTITION BY video ORDER BY frame_index) AS BIGINT) AS total FROM n""",
    "loading_percent": """SELECT user_id, event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / (count(*) OVER (PARTITION BY user_id))::DOUBLE * 60, 6) AS loading_percent FROM events""",
    "frame_percent": f"{_P} SELECT event_id, least(99, floor(done * 100.0::DOUBLE / 900 + 0.5))::DOUBLE AS percent FROM (SELECT * FROM progress WHERE done IS NOT NULL) UNION ALL SELECT event_id, 99.0::DOUBLE * NULL FROM progress WHERE done IS NULL",
    "phase_steps": f"""{_P} SELECT event_id, CAST(CASE phase {' '.join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(STEPS))} WHEN 'waiting-selection' THEN {len(STEPS)} WHEN 'done' THEN {len(STEPS)} ELSE 0 END AS BIGINT) AS step,
  printf('%.1f', event_id * 7919 / 1048576.0::DOUBLE) AS size FROM progress""",
    "merged_progress": f"""{_P} SELECT user_id, {', '.join(f"arg_max({c}, event_id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("phase", "description", "done"))} FROM progress GROUP BY user_id""",
    "select_all": "SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 2 = 0",
    "all_selected": """WITH c AS (SELECT user_id, event_type, user_id % 2 = 0 AND count(*) % 2 = 1 AS chosen FROM events GROUP BY 1, 2) SELECT user_id, bool_and(chosen) AS all_selected FROM c GROUP BY 1""",
    "override_clear": """WITH e AS (SELECT *, event_id % 5 AS item, max(CASE WHEN event_id % 17 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS cleared FROM events)
SELECT user_id, item, max(event_id) AS event_id, arg_max(event_type, event_id) AS style FROM e WHERE event_id % 17 <> 0 AND (cleared IS NULL OR event_id > cleared) GROUP BY 1, 2""",
}

_CROWDED = f"WITH singles AS ({BOXES}), boxes AS (SELECT * REPLACE (CAST(floor(frame_index / 50) AS BIGINT) AS frame_index) FROM singles)"
_RECORDED = f"WITH r AS ({RECORDED}), n AS (SELECT video, count(*) AS n FROM r GROUP BY video)"
SQL |= {
    "nms_crowded": SQL["nms_per_frame"].replace(_B, _CROWDED),
    "cosine_pairs_pruned": SQL["cosine_pairs"],
    "identity_match_pruned": SQL["identity_match_top1"],
    "kalman_long": SQL["kalman_batch"],
    "greedy_crowded": SQL["greedy_match"],
    "frames_by_range": f"{_RECORDED} SELECT video, frame_index, round(frame_index / 30, 6) AS ts_sec, 8 AS width, 4 AS height, value FROM r",
    "frames_at_samples": f"""{_RECORDED}, t AS (SELECT video, unnest(range(0, CAST(ceil(n / 30.0 - 0.2) AS BIGINT))) AS k FROM n)
SELECT DISTINCT video, frame_index, value FROM t JOIN r USING (video) WHERE frame_index = 3 + 30 * k""",
    "segments_in_order": f"""{_RECORDED} SELECT video, CAST(floor(frame_index / 100) AS BIGINT) AS segment, frame_index,
  'frame_' || lpad(CAST(frame_index + 1 AS VARCHAR), 4, '0') || '.jpg' AS file_name, value FROM r""",
}

SQL["hungarian_match"] = f"""WITH RECURSIVE obs AS ({OBS}), p AS (SELECT b.frame_index, a.det_id AS a, b.det_id AS b, 1 - {_iou('a', 'b')} AS cost
  FROM obs a JOIN obs b ON b.frame_index = a.frame_index + 2 WHERE a.observed AND b.observed),
c AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY frame_index ORDER BY a) AS turn, dense_rank() OVER (PARTITION BY frame_index ORDER BY b) AS place FROM p),
n AS (SELECT frame_index, max(turn) AS rows, least(max(turn), max(place)) AS pairs FROM c GROUP BY 1),
o AS MATERIALIZED (SELECT frame_index, turn, CAST(1 AS BIGINT) << CAST(place - 1 AS INT) AS bit, cost FROM c
  UNION ALL SELECT DISTINCT frame_index, turn, CAST(0 AS BIGINT), 0.0::DOUBLE FROM c),
s AS (SELECT frame_index, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS used, 0.0::DOUBLE AS total FROM n
  UNION ALL SELECT s.frame_index, o.turn, s.used | o.bit, min(s.total + o.cost) FROM s JOIN o ON o.frame_index = s.frame_index AND o.turn = s.turn + 1 WHERE s.used & o.bit = 0 GROUP BY ALL)
SELECT s.frame_index, round(min(total), 6) AS total, any_value(pairs) AS pairs FROM s JOIN n ON n.frame_index = s.frame_index AND turn = rows AND bit_count(used) = pairs GROUP BY 1"""


def _list_iou(a: str, b: str) -> str:
    """Overlap of two boxes that are lists of corners."""
    w, h = (f"(least({a}[{k + 2}], {b}[{k + 2}]) - greatest({a}[{k}], {b}[{k}]))" for k in (1, 2))
    area = lambda r: f"(({r}[3] - {r}[1]) * ({r}[4] - {r}[2]))"
    return f"(CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0 ELSE {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) END)"


_AXES = range(1, 5)
_TRACK = "STRUCT(i INT, x DOUBLE[], v DOUBLE[], p DOUBLE, q DOUBLE, age INT)[]"
# One row a video and frame. Its tracks are a list in the order of their making; all four coordinates of a track share their variances.
_TRACKS = f"""WITH RECURSIVE {_CENTROIDS}, obs AS ({OBS}), b AS (SELECT *, CAST(floor(frame_index / 250) AS BIGINT) AS video_id FROM obs),
people AS (SELECT CAST(label AS INT) AS id, list(m / n ORDER BY i) AS c FROM m JOIN n USING (label) GROUP BY label),
w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
own AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM w),
face AS (SELECT b.*, CASE WHEN u IS NULL THEN c ELSE list_transform(list_zip(c, u), lambda z: z[1] + z[2] * 0.5::DOUBLE) END AS f
  FROM b LEFT JOIN people ON id = obj_id LEFT JOIN own ON vec_id = det_id WHERE observed AND frame_index % 2 = 0),
likely AS (SELECT det_id, id, list_dot_product(f, c) / sqrt(list_dot_product(f, f)) AS sim FROM face, people WHERE f IS NOT NULL AND x2 - x1 >= 20 AND y2 - y1 >= 20),
likes AS (SELECT det_id, list(id ORDER BY sim DESC, id) AS likes FROM likely WHERE sim > 0.45::DOUBLE GROUP BY det_id),
near AS (SELECT a.det_id, b.obj_id AS id, b.det_id AS ord, {_iou('a', 'b')} AS iou FROM b a JOIN b ON b.video_id = a.video_id AND b.frame_index % 30 = 0 AND (b.obj_id + b.video_id) % 4 <> 3
  WHERE a.observed AND a.frame_index % 2 = 0),
nearest AS (SELECT det_id, list(id ORDER BY iou DESC, ord) AS near FROM (SELECT *, row_number() OVER (PARTITION BY det_id, id ORDER BY iou DESC, ord) AS n FROM near WHERE iou > 0.15::DOUBLE) WHERE n = 1 GROUP BY det_id),
dets AS MATERIALIZED (SELECT video_id, frame_index, list({{b: [x1, y1, x2, y2], near: coalesce(near, []), likes: coalesce(likes, [])}} ORDER BY face.det_id) AS ds
  FROM face LEFT JOIN nearest USING (det_id) LEFT JOIN likes USING (det_id) GROUP BY 1, 2),
ends AS (SELECT video_id, min(frame_index) AS lo, max(frame_index) AS hi FROM b WHERE observed GROUP BY 1),
t AS (SELECT video_id, lo - 1 AS frame_index, hi, CAST([] AS {_TRACK}) AS ts FROM ends
  UNION ALL
  SELECT video_id, f, hi, list_concat(
    list_transform(list_zip(ts, zs), lambda e: CASE WHEN e[2] IS NULL THEN e[1] ELSE {{i: e[1].i,
      x: [{', '.join(f'e[1].x[{k}] + e[1].p / (e[1].p + 2) * (e[2][{k}] - e[1].x[{k}])' for k in _AXES)}],
      v: [{', '.join(f'e[1].v[{k}] + e[1].q / (e[1].p + 2) * (e[2][{k}] - e[1].x[{k}])' for k in _AXES)}],
      p: e[1].p * (1 - e[1].p / (e[1].p + 2)), q: e[1].q * (1 - e[1].q / (e[1].p + 2)), age: 0}} END),
    list_transform(fresh, lambda e: {{i: e.i, x: ds[e.d].b, v: [0.0::DOUBLE, 0, 0, 0], p: 10.0::DOUBLE, q: 100.0::DOUBLE, age: 0}}))
  FROM (SELECT *, list_transform(range(1, len(ts) + 1), lambda k: ds[list_filter(won, lambda e: e.k = k)[1].d].b) AS zs,
      list_reduce(list_transform(free, lambda d: [{{i: CAST(NULL AS INT), d: d}}]), lambda done, e:
        CASE WHEN list_contains(list_transform(done, lambda x: x.d), e[1].d) THEN done ELSE list_concat(done, list_transform(
          list_filter(ds[e[1].d].likes, lambda c: NOT list_contains(ids, c) AND NOT list_contains(list_transform(done, lambda x: x.i), c))[1:1], lambda c: {{i: c, d: e[1].d}})) END, scanned) AS fresh
    FROM (SELECT *, list_reduce(list_transform(free, lambda d: [{{i: CAST(NULL AS INT), d: d}}]), lambda done, e:
        list_concat(done, list_transform(list_filter(ds[e[1].d].near, lambda c: NOT list_contains(ids, c) AND NOT list_contains(list_transform(done, lambda x: x.i), c))[1:1],
          lambda c: {{i: c, d: e[1].d}})), CAST([] AS STRUCT(i INT, d BIGINT)[])) AS scanned
      FROM (SELECT *, list_transform(ts, lambda e: e.i) AS ids, list_filter(range(1, len(ds) + 1), lambda d: NOT list_contains(list_transform(won, lambda e: e.d), d)) AS free
        FROM (SELECT *, list_reduce(list_transform(list_sort(pairs), lambda e: [e]), lambda done, e:
            CASE WHEN len(list_filter(done, lambda x: x.d = e[1].d OR x.k = e[1].k)) > 0 THEN done ELSE list_concat(done, e) END, CAST([] AS STRUCT(s DOUBLE, d BIGINT, k BIGINT)[])) AS won
          FROM (SELECT *, flatten(list_transform(range(1, len(ds) + 1), lambda d: list_filter(
              list_transform(range(1, len(ts) + 1), lambda k: {{s: -{_list_iou('ds[d].b', 'ts[k].x')}, d: d, k: k}}), lambda e: e.s <= -0.1::DOUBLE))) AS pairs
            FROM (SELECT t.video_id, t.frame_index + 1 AS f, t.hi, coalesce(d.ds, []) AS ds, list_transform(
                CASE WHEN (t.frame_index + 1) % 2 = 0 THEN list_filter(t.ts, lambda e: e.age <= 15) ELSE t.ts END,
                lambda e: {{i: e.i, x: [{', '.join(f'e.x[{k}] + e.v[{k}]' for k in _AXES)}], v: e.v, p: e.p + (2 * e.q + 4), q: e.q + 2, age: e.age + 1}}) AS ts
              FROM t LEFT JOIN dets d ON d.video_id = t.video_id AND d.frame_index = t.frame_index + 1 WHERE t.frame_index < t.hi)))))))
SELECT video_id, frame_index, e.i AS cluster_id, {', '.join(f'round(e.x[{k}], 4) AS {c}' for k, c in zip(_AXES, ('x1', 'y1', 'x2', 'y2')))}
FROM (SELECT video_id, frame_index, hi, unnest(ts) AS e FROM t)"""
SQL["tracker_full"] = _TRACKS
SQL["tracker_stream"] = f"{_TRACKS} WHERE frame_index < hi OR hi % 250 = 249"
