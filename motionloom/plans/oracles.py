"""DuckDB SQL for the queries of the same names. Steps are common table expressions, which each query takes up to its own."""

from __future__ import annotations

SCALE, FPS = "(4.975e0 / 97.01e0)", "22.46e0"

STEPS = {
    "e": """SELECT user_id AS run_id, event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
            CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame FROM events""",
    "walk": """SELECT *, 1518 + sum(16 * (k % 21 - 10)) OVER w AS xr, 1529 + sum(16 * ((k * 37) % 21 - 10)) OVER w AS yr
            FROM e WINDOW w AS (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "det": """SELECT run_id, frame, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE xr END AS INT) AS x, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE yr END AS INT) AS y,
            CAST(CASE WHEN event_type = 'error' THEN 0 ELSE (frame * 15 + k) % 360 - 180 END AS DOUBLE) AS theta FROM walk""",
    "trk": f"SELECT run_id, frame, frame / {FPS} AS time, x * {SCALE} AS x, y * {SCALE} AS y, theta, (x = 0 AND y = 0 AND theta = 0) AS s FROM det",
    "pos": """SELECT *, min(CASE WHEN NOT s THEN rn END) OVER (PARTITION BY run_id) AS first_, max(CASE WHEN NOT s THEN rn END) OVER (PARTITION BY run_id) AS last_
            FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY time) - 1 AS INT) AS rn FROM trk)""",
    "trim": "SELECT run_id, frame, time, x, y, theta, s, rn - first_ AS rn FROM pos WHERE rn BETWEEN first_ AND last_",
    "stretch": "SELECT run_id, g, count(*) AS n FROM (SELECT run_id, rn - row_number() OVER (PARTITION BY run_id ORDER BY rn) AS g FROM trim WHERE s) GROUP BY run_id, g",
    "longest": "SELECT run_id, max(n) AS longest FROM stretch GROUP BY run_id",
    "stats": """SELECT a.run_id, a.n_rows, coalesce(b.n_middle, 0) AS n_middle, coalesce(b.n_skipped, 0) AS n_skipped, b.fraction, coalesce(longest, 0) AS longest
            FROM (SELECT run_id, count(*) AS n_rows FROM trk GROUP BY run_id) a
            LEFT JOIN (SELECT run_id, count(*) AS n_middle, count(*) FILTER (s) AS n_skipped, avg(CAST(s AS INT)) AS fraction FROM trim GROUP BY run_id) b USING (run_id)
            LEFT JOIN longest USING (run_id)""",
    "reason": """SELECT *, CASE WHEN n_middle = 0 THEN 'all_skipped' WHEN fraction > 0.3e0 THEN 'fraction' WHEN longest > 4 THEN 'consecutive' END AS reason FROM stats""",
    "near": """SELECT *, max(CASE WHEN NOT s THEN rn END) OVER (PARTITION BY run_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rp,
            min(CASE WHEN NOT s THEN rn END) OVER (PARTITION BY run_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rq FROM trim""",
    "fill": """SELECT n.run_id, n.frame, n.time, n.rn,
            CASE WHEN n.rp = n.rq THEN p.x ELSE p.x + (q.x - p.x) * (n.rn - n.rp) / (n.rq - n.rp) END AS x,
            CASE WHEN n.rp = n.rq THEN p.y ELSE p.y + (q.y - p.y) * (n.rn - n.rp) / (n.rq - n.rp) END AS y,
            CASE WHEN n.rp = n.rq THEN p.theta ELSE p.theta + (q.theta - p.theta) * (n.rn - n.rp) / (n.rq - n.rp) END AS theta
            FROM near n JOIN trim p ON p.run_id = n.run_id AND p.rn = n.rp JOIN trim q ON q.run_id = n.run_id AND q.rn = n.rq""",
    "wall": f"""SELECT run_id, frame, time, rn, x, y, theta FROM (
            SELECT *, min(CASE WHEN sqrt((x * (97.01e0 / 4.975e0) - 1518) * (x * (97.01e0 / 4.975e0) - 1518) + (y * (97.01e0 / 4.975e0) - 1529) * (y * (97.01e0 / 4.975e0) - 1529)) > 1200 THEN rn END)
            OVER (PARTITION BY run_id) AS hit FROM fill) WHERE hit IS NULL OR rn < hit""",
    "cln": "SELECT wall.* FROM wall JOIN reason USING (run_id) WHERE reason IS NULL",
    "size_": "SELECT run_id, count(*) AS n, CASE WHEN count(*) > 1 THEN (max(time) - min(time)) / (count(*) - 1) END AS dt FROM cln GROUP BY run_id",
    "turn": "SELECT *, radians(theta) - lag(radians(theta)) OVER (PARTITION BY run_id ORDER BY rn) AS d FROM cln",
    "turn2": "SELECT *, (((d + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() AS m FROM turn",
    "unw": """SELECT *, radians(theta) + sum(CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE CASE WHEN m = -pi() AND d > 0 THEN pi() ELSE m END - d END)
            OVER (PARTITION BY run_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM turn2""",
    "grad": """SELECT run_id, rn, CASE WHEN hd IS NULL THEN (f2 - u) / hs WHEN hs IS NULL THEN (u - f0) / hd
            ELSE (hd * hd * f2 + (hs * hs - hd * hd) * u - hs * hs * f0) / (hd * hs * (hd + hs)) END AS g
            FROM (SELECT run_id, rn, u, time - lag(time) OVER w AS hd, lead(time) OVER w - time AS hs, lag(u) OVER w AS f0, lead(u) OVER w AS f2 FROM unw WINDOW w AS (PARTITION BY run_id ORDER BY rn))""",
    "lags": "SELECT *, CAST(unnest(generate_series(1, n_taus)) AS INT) AS tau FROM (SELECT *, least(CAST(trunc(1.5e0 / dt) AS BIGINT), n) - 1 AS n_taus FROM size_ WHERE n > 1 AND dt > 0) WHERE n_taus > 0",
    "msd": """SELECT l.run_id, l.n_taus, l.tau, (l.tau * l.dt) * (l.tau * l.dt) AS tau2, avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS msd
            FROM lags l JOIN cln a ON a.run_id = l.run_id JOIN cln b ON b.run_id = l.run_id AND b.rn = a.rn + l.tau GROUP BY l.run_id, l.n_taus, l.tau, l.dt""",
    "fit": """SELECT run_id, n_fit, CASE WHEN count(*) > 1 THEN regr_slope(msd, tau2) ELSE 0 END AS slope, CASE WHEN count(*) > 1 THEN regr_intercept(msd, tau2) ELSE avg(msd) END AS intercept
            FROM (SELECT *, CAST(trunc(n_taus * 0.3e0) AS INT) AS n_fit FROM msd) WHERE tau <= n_fit GROUP BY run_id, n_fit""",
    "vel": "SELECT *, CASE WHEN slope < 0 THEN 0 ELSE sqrt(slope) END AS v FROM fit",
    "keys_": "SELECT DISTINCT user_id AS run_id, CAST(30 + 10 * (user_id % 9) AS INT) AS pwm, CAST((user_id // 9) % 10 AS INT) AS trial FROM events",
    "mid": """SELECT c.*, m.time - 1 AS t_min, m.time + 1 AS t_max FROM cln c JOIN size_ z ON z.run_id = c.run_id JOIN cln m ON m.run_id = c.run_id AND m.rn = z.n // 2
            WHERE c.time >= m.time - 1 AND c.time <= m.time + 1""",
    "about": "SELECT *, x - avg(x) OVER (PARTITION BY run_id) AS u, y - avg(y) OVER (PARTITION BY run_id) AS w, avg(x) OVER (PARTITION BY run_id) AS mx, avg(y) OVER (PARTITION BY run_id) AS my FROM mid",
    "sums": """SELECT run_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS uu, sum(w * w) AS vv, sum(u * w) AS uv, sum(u * u * u + u * w * w) AS p, sum(w * w * w + w * u * u) AS q
            FROM about GROUP BY run_id""",
    "kasa": """SELECT run_id, n, mx + a AS xc, my + b AS yc, sqrt(a * a + b * b + (uu + vv) / n) AS radius
            FROM (SELECT *, (p * vv - q * uv) / 2 / nullif(uu * vv - uv * uv, 0) AS a, (q * uu - p * uv) / 2 / nullif(uu * vv - uv * uv, 0) AS b FROM sums)""",
    "cell": "SELECT CAST(c // 16 AS INT) AS i, CAST(c % 16 AS INT) AS j FROM (SELECT unnest(generate_series(0, 255)) AS c)",
    "lit": """SELECT run_id, frame, i, j, k, ci, cj, event_type <> 'error' AND (i - ci) * (i - ci) + (j - cj) * (j - cj) <= 25 AND NOT (i - ci > 1 AND j - cj BETWEEN -1 AND 1) AS on_
            FROM (SELECT *, 7 + frame % 3 AS ci, 7 + k % 3 AS cj FROM e), cell""",
    "rgb": """SELECT *, CASE WHEN on_ THEN 40 + k ELSE 0 END AS ub, CASE WHEN on_ THEN 35 + (k * 3) % 50 ELSE 0 END AS ug, CASE WHEN on_ THEN 30 + (k * 7) % 60 ELSE 0 END AS ur FROM lit""",
    "pix": "SELECT *, (299 * ur + 587 * ug + 114 * ub + 500) // 1000 AS up FROM rgb",
    "white": "SELECT run_id, frame, i, j, ci, cj, CASE WHEN up > 12 THEN 255 ELSE 0 END AS v FROM pix",
    # squares of four neighbouring pixels: a region without holes is made of full squares and half ones
    "quad": """SELECT * FROM (SELECT run_id, frame, i, j, a, lead(a, 1) OVER w AS b, lead(a, 16) OVER w AS c, lead(a, 17) OVER w AS d
            FROM (SELECT run_id, frame, i, j, CAST(v > 0 AS INT) AS a FROM white) WINDOW w AS (PARTITION BY run_id, frame ORDER BY i, j)) WHERE i < 15 AND j < 15""",
    "pairs": """SELECT run_id, frame, sum(CASE WHEN a + b + c + d = 4 THEN 2 WHEN a + b + c + d = 3 THEN 1 ELSE 0 END) AS twice,
            sum(CASE WHEN a + b + c + d = 4 THEN 6 * j + 3 WHEN a + b + c + d = 3 THEN 3 * j + b + d ELSE 0 END) AS mx, sum(CASE WHEN a + b + c + d = 4 THEN 6 * i + 3 WHEN a + b + c + d = 3 THEN 3 * i + c + d ELSE 0 END) AS my,
            sum(CASE WHEN a + b + c + d = 4 THEN -4 WHEN a + b + c + d = 3 THEN -2 ELSE 0 END) + 2 * sum(a * b + a * c + CASE WHEN i = 14 THEN c * d ELSE 0 END + CASE WHEN j = 14 THEN b * d ELSE 0 END) AS straight,
            sum(CASE WHEN a + b + c + d = 3 THEN 1 WHEN a + b + c + d = 2 AND a = d THEN 2 ELSE 0 END) AS slant FROM quad GROUP BY run_id, frame""",
    "region": """SELECT run_id, frame, 0 AS contour, twice / 2.0e0 AS area, straight + slant * sqrt(2.0e0) AS perimeter,
            CASE WHEN twice > 0 THEN CAST(mx // (3 * twice) AS INT) END AS x, CASE WHEN twice > 0 THEN CAST(my // (3 * twice) AS INT) END AS y
            FROM pairs JOIN (SELECT DISTINCT run_id, frame FROM white WHERE v > 0) USING (run_id, frame)""",
    "bot": """SELECT r.run_id, r.frame, r.x, r.y, round(atan2(sum(i) / CAST(count(*) AS DOUBLE) - r.y, sum(j) / CAST(count(*) AS DOUBLE) - r.x) * 180 / pi(), 6) AS theta
            FROM region r JOIN white p ON p.run_id = r.run_id AND p.frame = r.frame AND p.v > 0 AND (p.i - r.y) * (p.i - r.y) + (p.j - r.x) * (p.j - r.x) <= 36
            WHERE area > 30 AND area < 90 AND perimeter > 20 AND perimeter < 80 GROUP BY r.run_id, r.frame, r.x, r.y""",
    "poly": """SELECT event_id, w, s, h, k, (w * h + (w + s) * h) AS cross2 FROM (SELECT event_id, k, 1 + k % 20 AS w, k % 5 AS s, 1 + (k * 7) % 15 AS h
            FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))""",
    # corners (0,0) (w,0) (w+s,h) (0,h), moved by (k, 2k)
    "meas": """SELECT event_id, (w * h + (w + s) * h) / 2.0e0 AS area, w + sqrt(CAST(s * s + h * h AS DOUBLE)) + (w + s) + h AS perimeter,
            CAST(trunc((k * 3.0e0 * cross2 + (w + w + s) * (w * h) + (w + s) * ((w + s) * h)) / (3.0e0 * cross2)) AS INT) AS x,
            CAST(trunc((2 * k * 3.0e0 * cross2 + h * (w * h) + 2 * h * ((w + s) * h)) / (3.0e0 * cross2)) AS INT) AS y FROM poly""",
    "link": """SELECT run_id, frame, x, y, theta, CAST(sum(new_) OVER (PARTITION BY run_id ORDER BY frame) - 1 AS INT) AS particle
            FROM (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR frame <> lag(frame) OVER w + 1
                  OR sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) > 200 THEN 1 ELSE 0 END AS new_
                  FROM det WINDOW w AS (PARTITION BY run_id ORDER BY frame))""",
    "clip": "SELECT *, since - idx * 0.625e0 AS clip_time FROM (SELECT *, time - 0.25e0 AS since, CAST(floor((time - 0.25e0) / 0.625e0) AS INT) AS idx FROM trk) WHERE idx BETWEEN 0 AND 3 AND since - idx * 0.625e0 < 0.5e0",
    "have": "SELECT DISTINCT 'pog_' || run_id AS pog, CASE WHEN idx < 2 THEN 30 ELSE 40 END AS pwm, idx % 2 AS trial FROM clip",
    "want": "SELECT 'pog_' || run_id AS pog, unnest([30, 40, 50]) AS pwm, trial FROM (SELECT run_id, unnest([0, 1]) AS trial FROM keys_)",
    "spec": """SELECT run_id, n, dt, CAST(kk AS INT) AS k, pow(sum(radians(theta) * cos(2 * pi() * kk / n * rn)), 2) + pow(sum(radians(theta) * sin(2 * pi() * kk / n * rn)), 2) AS power
            FROM cln JOIN (SELECT *, unnest(generate_series(1, n // 2 - 1)) AS kk FROM size_ WHERE n >= 4) USING (run_id) GROUP BY run_id, n, dt, kk""",
    # a low-pass of order 4 at 1 Hz from its poles, and what it needs of each run
    "pole": """SELECT *, (4 + w * cos(pi() / 8)) * (4 + w * cos(pi() / 8)) + w * w * sin(pi() / 8) * sin(pi() / 8) AS d1, (4 + w * cos(3 * pi() / 8)) * (4 + w * cos(3 * pi() / 8)) + w * w * sin(3 * pi() / 8) * sin(3 * pi() / 8) AS d3
            FROM (SELECT run_id, n, dt, 4 * tan(pi() * dt) AS w FROM size_ WHERE n > 15 AND 2 * dt > 0 AND 2 * dt < 1)""",
    "pole2": """SELECT run_id, n, dt, w * w * w * w / (d1 * d3) AS g, -2 * (16 - w * w) / d1 AS p1, ((4 - w * cos(pi() / 8)) * (4 - w * cos(pi() / 8)) + w * w * sin(pi() / 8) * sin(pi() / 8)) / d1 AS q1,
            -2 * (16 - w * w) / d3 AS p3, ((4 - w * cos(3 * pi() / 8)) * (4 - w * cos(3 * pi() / 8)) + w * w * sin(3 * pi() / 8) * sin(3 * pi() / 8)) / d3 AS q3 FROM pole""",
    "coef": "SELECT run_id, n, dt, g, p1 + p3 AS a1, q1 + q3 + p1 * p3 AS a2, p1 * q3 + p3 * q1 AS a3, q1 * q3 AS a4 FROM pole2",
    "rest": """SELECT *, g - a4 AS z4, 4 * g - a3 + g - a4 AS z3, 6 * g - a2 + 4 * g - a3 + g - a4 AS z2, 4 * g - a1 + 6 * g - a2 + 4 * g - a3 + g - a4 AS z1 FROM coef""",
    "rad": "SELECT r.run_id, rn, n, radians(theta) AS v FROM cln JOIN rest r ON r.run_id = cln.run_id",
    "ends": "SELECT run_id, any_value(n) AS n, max(CASE WHEN rn = 0 THEN v END) AS v0, max(CASE WHEN rn = n - 1 THEN v END) AS v1 FROM rad GROUP BY run_id",
    # mirrored through both ends by 15 samples; t counts from the first
    "long_": """SELECT run_id, CAST(rn + 15 AS INT) AS t, v FROM rad UNION ALL SELECT run_id, CAST(15 - rn AS INT), 2 * v0 - v FROM rad JOIN ends USING (run_id) WHERE rn BETWEEN 1 AND 15
            UNION ALL SELECT run_id, CAST(2 * (ends.n - 1) - rn + 15 AS INT), 2 * v1 - v FROM rad JOIN ends USING (run_id) WHERE rn BETWEEN ends.n - 16 AND ends.n - 2""",
    "ahead": """SELECT run_id, t, v, g * v + z1 * v AS y, 4 * g * v - a1 * (g * v + z1 * v) + z2 * v AS s1, 6 * g * v - a2 * (g * v + z1 * v) + z3 * v AS s2, 4 * g * v - a3 * (g * v + z1 * v) + z4 * v AS s3, g * v - a4 * (g * v + z1 * v) AS s4
            FROM long_ JOIN rest USING (run_id) WHERE t = 0
            UNION ALL SELECT run_id, x.t, x.v, g * x.v + s1, 4 * g * x.v - a1 * (g * x.v + s1) + s2, 6 * g * x.v - a2 * (g * x.v + s1) + s3, 4 * g * x.v - a3 * (g * x.v + s1) + s4, g * x.v - a4 * (g * x.v + s1)
            FROM ahead p JOIN long_ x USING (run_id) JOIN rest USING (run_id) WHERE x.t = p.t + 1""",
    "turned": "SELECT run_id, CAST(n + 29 - t AS INT) AS t, y AS v FROM ahead JOIN rest USING (run_id)",
    "backward": """SELECT run_id, t, v, g * v + z1 * v AS y, 4 * g * v - a1 * (g * v + z1 * v) + z2 * v AS s1, 6 * g * v - a2 * (g * v + z1 * v) + z3 * v AS s2, 4 * g * v - a3 * (g * v + z1 * v) + z4 * v AS s3, g * v - a4 * (g * v + z1 * v) AS s4
            FROM turned JOIN rest USING (run_id) WHERE t = 0
            UNION ALL SELECT run_id, x.t, x.v, g * x.v + s1, 4 * g * x.v - a1 * (g * x.v + s1) + s2, 6 * g * x.v - a2 * (g * x.v + s1) + s3, 4 * g * x.v - a3 * (g * x.v + s1) + s4, g * x.v - a4 * (g * x.v + s1)
            FROM backward p JOIN turned x USING (run_id) JOIN rest USING (run_id) WHERE x.t = p.t + 1""",
    "smooth": "SELECT run_id, n, dt, n + 14 - t AS rn, y FROM backward JOIN rest USING (run_id) WHERE t BETWEEN 15 AND n + 14",
    "filtered": """SELECT run_id, n, dt, kk, pow(sum(y * cos(2 * pi() * kk / n * rn)), 2) + pow(sum(y * sin(2 * pi() * kk / n * rn)), 2) AS power
            FROM smooth JOIN (SELECT run_id, unnest(generate_series(1, n // 2 - 1)) AS kk FROM rest) USING (run_id) GROUP BY run_id, n, dt, kk""",
    "fft_": "SELECT run_id, 2 * pi() * kk / (n * dt) AS omega_fft FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY power DESC, kk) AS r FROM filtered) WHERE r = 1",
    "arc": f"""SELECT run_id, frame, frame AS rn, frame / {FPS} AS time, 70 + run_id % 11 + (8 + run_id % 7) * cos(a) + ((k * 7) % 11 - 5) * 0.01e0 AS x, 75 - run_id % 5 + (8 + run_id % 7) * sin(a) + ((k * 3) % 13 - 6) * 0.01e0 AS y,
            degrees(a) + 270 - 360 * floor((degrees(a) + 270) / 360) - 180 AS theta FROM (SELECT *, run_id * 0.37e0 + frame * 0.11e0 AS a FROM e)""",
    # what a shape's outer border encloses, by level: f. v is the image itself
    "kinds_": "SELECT DISTINCT k, CAST(frame % 6 AS INT) AS p FROM e WHERE event_type <> 'error'",
    "level": """SELECT k, p, i, j, CASE WHEN r16 THEN 40 WHEN l2 <= CASE WHEN k % 5 = 0 THEN 1 ELSE 9 END THEN core WHEN l2 <= 36 THEN halo ELSE 0 END AS f,
            CASE WHEN r16 THEN 40 WHEN k % 5 = 0 AND l2 > 1 AND l2 <= 9 THEN 0 WHEN l2 <= CASE WHEN k % 5 = 0 THEN 1 ELSE 9 END THEN core WHEN l2 <= 36 THEN halo ELSE 0 END AS v
            FROM (SELECT *, CASE WHEN k % 7 = 3 THEN 0 ELSE 15 + k % 16 END AS halo, CASE WHEN k % 7 = 3 THEN 14 + k % 10 ELSE 25 + k % 16 END AS core,
                  (i - (7 + p % 3)) * (i - (7 + p % 3)) + (j - (7 + k % 3)) * (j - (7 + k % 3)) AS l2, (i - (7 + k % 3)) * (i - (7 + k % 3)) + (j - (23 + p % 2)) * (j - (23 + p % 2)) <= 16 AS r16
                  FROM kinds_, (SELECT unnest(generate_series(-1, 16)) AS i), (SELECT unnest(generate_series(-1, 32)) AS j))""",
    "cands": """SELECT CAST(r AS INT) AS rank, CASE WHEN r = 0 OR r = 13 THEN 20 WHEN r <= 6 THEN 20 + r ELSE 26 - r END AS t, CASE WHEN r = 13 THEN 150 ELSE 60 END AS most, CASE WHEN r = 13 THEN 60 ELSE 40 END AS longest
            FROM (SELECT unnest(generate_series(0, 13)) AS r) UNION ALL SELECT 99, 17, 999, 999""",
    "corner": """SELECT k, p, rank, i, j, CAST(j > 15 AS INT) AS half_, CAST(f > t AS INT) AS a, CAST(fb > t AS INT) AS b, CAST(fc > t AS INT) AS c, CAST(fd > t AS INT) AS d
            FROM (SELECT *, lead(f, 1) OVER w AS fb, lead(f, 34) OVER w AS fc, lead(f, 35) OVER w AS fd FROM level WINDOW w AS (PARTITION BY k, p ORDER BY i, j)), cands WHERE i < 16 AND j < 32""",
    "blob": """SELECT k, p, rank, half_, min(CASE WHEN a = 1 THEN i * 100 + j END) AS first_, sum(CASE WHEN a + b + c + d = 4 THEN 2 WHEN a + b + c + d = 3 THEN 1 ELSE 0 END) AS twice,
            sum(CASE WHEN a + b + c + d = 4 THEN 6 * j + 3 WHEN a + b + c + d = 3 THEN 3 * j + b + d ELSE 0 END) AS mx, sum(CASE WHEN a + b + c + d = 4 THEN 6 * i + 3 WHEN a + b + c + d = 3 THEN 3 * i + c + d ELSE 0 END) AS my,
            sum(CASE WHEN a + b + c + d = 2 THEN CASE WHEN a = d THEN 2 * sqrt(2.0e0) ELSE 1 END WHEN a + b + c + d = 3 THEN sqrt(2.0e0) ELSE 0 END) AS perimeter
            FROM corner WHERE a + b + c + d > 0 GROUP BY k, p, rank, half_""",
    "fits": """SELECT b.*, CAST(mx // (3 * twice) AS INT) AS x, CAST(my // (3 * twice) AS INT) AS y FROM blob b JOIN cands USING (rank)
            WHERE rank < 99 AND twice > 30 AND twice < 2 * most AND perimeter > 8 AND perimeter < longest""",
    "winner": "SELECT k, p, min(rank) AS rank FROM (SELECT k, p, rank FROM fits GROUP BY k, p, rank HAVING count(*) = 2) GROUP BY k, p",
    "found_": """SELECT k, p, rank, x, y, round(atan2(sum(v.i) / CAST(count(*) AS DOUBLE) - y, sum(v.j) / CAST(count(*) AS DOUBLE) - x) * 180 / pi(), 6) AS theta
            FROM fits JOIN winner USING (k, p, rank) JOIN cands USING (rank) JOIN level v USING (k, p) WHERE v.v > t AND (v.i - y) * (v.i - y) + (v.j - x) * (v.j - x) <= 25 GROUP BY k, p, rank, half_, x, y""",
    # several bots: all ways to pair the points of two neighbouring frames, one point after another, and the cheapest of them
    "spot": "SELECT run_id // 4 AS video_id, run_id, frame, x, y, theta, CAST(row_number() OVER (PARTITION BY run_id // 4, frame ORDER BY x, y, run_id) AS INT) AS i FROM det WHERE NOT (x = 0 AND y = 0 AND theta = 0)",
    "step_": """SELECT b.video_id, a.frame, b.i, a.i AS j, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) - 80000 AS gain FROM spot a JOIN spot b ON a.video_id = b.video_id AND b.frame = a.frame + 1
            WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 40000
            UNION ALL SELECT video_id, frame - 1, i, 9, 0 FROM spot""",
    "paired": """SELECT video_id, frame, 0 AS i, 0 AS used, CAST(0 AS BIGINT) AS gain, CAST([] AS INT[]) AS chosen FROM (SELECT DISTINCT video_id, frame - 1 AS frame FROM spot)
            UNION ALL SELECT p.video_id, p.frame, s.i, CASE WHEN j < 9 THEN used | (1 << j) ELSE used END, p.gain + s.gain, list_append(chosen, j)
            FROM paired p JOIN step_ s ON s.video_id = p.video_id AND s.frame = p.frame AND s.i = p.i + 1 WHERE j = 9 OR used & (1 << j) = 0""",
    "cheapest": "SELECT video_id, frame, arg_min(chosen, (gain, chosen)) AS chosen FROM paired WHERE (video_id, frame, i) IN (SELECT (video_id, frame - 1, max(i)) FROM spot GROUP BY video_id, frame) GROUP BY video_id, frame",
    "prior": "SELECT video_id, frame + 1 AS frame, CAST(generate_subscripts(chosen, 1) AS INT) AS i, unnest(chosen) AS j FROM cheapest",
    "chained": """SELECT video_id, frame, i, frame AS head_frame, i AS head_i FROM prior WHERE j = 9
            UNION ALL SELECT p.video_id, p.frame, p.i, head_frame, head_i FROM chained c JOIN prior p ON p.video_id = c.video_id AND p.frame = c.frame + 1 AND p.j = c.i""",
    "numbered": "SELECT *, CAST(dense_rank() OVER (PARTITION BY video_id ORDER BY head_frame, head_i) - 1 AS INT) AS particle FROM chained",
}

FINAL = {
    "convert_units": "SELECT run_id, frame, round(time, 6) AS time, round(x, 6) AS x, round(y, 6) AS y, round(theta, 6) AS theta FROM trk",
    "px_roundtrip": f"SELECT run_id, frame, round(x * (97.01e0 / 4.975e0), 6) AS x_px, round(y * (97.01e0 / 4.975e0), 6) AS y_px, round(time * {FPS}, 6) AS frame_of_time FROM trk",
    "skipped_flag": "SELECT run_id, frame, s AS skipped FROM trk",
    "skipped_stats": "SELECT run_id, n_rows, n_middle, n_skipped, longest, round(fraction, 6) AS fraction FROM stats",
    "trim_edges": "SELECT run_id, frame, rn, round(time, 6) AS time, round(x, 6) AS x, round(y, 6) AS y, round(theta, 6) AS theta FROM trim",
    "discard_reason": "SELECT run_id, n_middle, n_skipped, longest, reason FROM reason",
    "interpolate": "SELECT run_id, frame, rn, round(time, 6) AS time, round(x, 6) AS x, round(y, 6) AS y, round(theta, 6) AS theta FROM fill",
    "wall_cut": "SELECT run_id, frame, rn, round(time, 6) AS time, round(x, 6) AS x, round(y, 6) AS y, round(theta, 6) AS theta FROM wall",
    "clean": "SELECT run_id, frame, rn, round(time, 6) AS time, round(x, 6) AS x, round(y, 6) AS y, round(theta, 6) AS theta FROM cln",
    "clean_row_counts": """SELECT run_id, n_rows AS n_raw, n_middle AS n_trimmed, coalesce(n, 0) AS n_clean FROM stats LEFT JOIN size_ USING (run_id)""",
    "link_single": "SELECT run_id, frame, x, y, particle FROM link",
    "candidate_pairs": """SELECT a.run_id, a.frame, a.x, a.y, b.x AS x2, b.y AS y2, CAST((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS BIGINT) AS dist2
            FROM det a JOIN det b ON a.run_id = b.run_id AND b.frame = a.frame + 1 WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 40000""",
    "link_multi": "SELECT video_id, run_id, frame, x, y, theta, particle FROM spot JOIN numbered USING (video_id, frame, i)",
    "fallback_ranks": "SELECT run_id, frame, rank, x, y, theta FROM e JOIN found_ f ON f.k = e.k AND f.p = e.frame % 6 WHERE event_type <> 'error'",
    "contours_nested": """SELECT run_id, frame, CAST(row_number() OVER (PARTITION BY run_id, frame ORDER BY first_) - 1 AS INT) AS contour, twice / 2.0e0 AS area, round(perimeter, 6) AS perimeter,
            CASE WHEN twice > 0 THEN CAST(mx // (3 * twice) AS INT) END AS x, CASE WHEN twice > 0 THEN CAST(my // (3 * twice) AS INT) END AS y
            FROM e JOIN blob b ON b.k = e.k AND b.p = e.frame % 6 WHERE event_type <> 'error' AND rank = 99 AND first_ IS NOT NULL""",
    "skip_placeholder": "SELECT run_id, frame, x, y, theta FROM det",
    "track": f"SELECT run_id, particle, round(frame / {FPS}, 6) AS time, round(x * {SCALE}, 6) AS x, round(y * {SCALE}, 6) AS y, round(theta, 6) AS theta FROM link",
    "mean_dt": "SELECT run_id, n, round(dt, 6) AS mean_dt FROM size_",
    "diff_time": "SELECT run_id, rn, round(time - lag(time) OVER (PARTITION BY run_id ORDER BY rn), 6) AS dt FROM cln",
    "unwrap": "SELECT run_id, rn, round(u, 6) AS theta_u FROM unw",
    "gradient": "SELECT run_id, rn, round(g, 6) AS dtheta FROM grad",
    "omega_noise": "SELECT run_id, round(abs(avg(g)), 6) AS omega_noise FROM grad GROUP BY run_id",
    "msd_curve": "SELECT run_id, tau, round(tau2, 6) AS tau2, round(msd, 6) AS msd FROM msd",
    "v_msd": "SELECT run_id, n_fit, round(v, 6) AS v_msd FROM vel",
    "msd_mean_by_pwm": """SELECT pwm, tau, n_runs, n_runs = all_ AS in_all, round(tau2, 6) AS tau2, round(msd, 6) AS msd
            FROM (SELECT pwm, tau, avg(tau2) AS tau2, avg(msd) AS msd, count(*) AS n_runs FROM msd JOIN keys_ USING (run_id) GROUP BY pwm, tau)
            JOIN (SELECT pwm, count(*) AS all_ FROM msd JOIN keys_ USING (run_id) WHERE tau = 1 GROUP BY pwm) USING (pwm)""",
    "mid_window": "SELECT run_id, rn, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max FROM mid",
    "circle_residuals": "SELECT run_id, rn, round(r, 6) AS radius, round(r - avg(r) OVER (PARTITION BY run_id), 6) AS residual FROM (SELECT *, sqrt(u * u + w * w) AS r FROM about)",
    "circle_kasa": "SELECT run_id, n, round(xc, 4) AS xc, round(yc, 4) AS yc, round(radius, 4) AS radius FROM kasa",
    "dft_peak": """SELECT run_id, k, round(2 * pi() * k / (n * dt), 6) AS omega FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY power DESC, k) AS r FROM spec) WHERE r = 1""",
    "omega_fft": "SELECT run_id, round(omega_fft, 6) AS omega_fft FROM size_ LEFT JOIN fft_ USING (run_id)",
    "physics_core": "SELECT run_id, pwm, trial, round(omega_fft, 6) AS omega_fft, round(omega_noise, 6) AS omega_noise, round(v, 6) AS v_msd FROM fft_ JOIN (SELECT run_id, abs(avg(g)) AS omega_noise FROM grad GROUP BY run_id) USING (run_id) JOIN vel USING (run_id) JOIN keys_ USING (run_id)",
    "omega_ucm": "SELECT run_id, round(CASE WHEN radius IS NULL OR isnan(radius) OR radius <= 0 THEN CAST('nan' AS DOUBLE) ELSE v / radius END, 4) AS omega_ucm FROM vel JOIN kasa USING (run_id)",
    "append_detections": "SELECT * FROM det",
    "physics_reasons": "SELECT run_id, CASE WHEN n <= 15 THEN 'too_short' WHEN 2 * dt >= 1 THEN 'too_coarse' WHEN trunc(0.3e0 * (least(trunc(1.5e0 / dt), n) - 1)) < 1 THEN 'no_lags' END AS reason FROM size_",
    "trim": """SELECT pog, pwm, trial, CAST(p * 10 + trial AS INT) AS run_index, round(5.2e0 + (p * 10 + trial) * (6 + 1.845e0), 6) AS clip_start, round(5.2e0 + (p * 10 + trial) * (6 + 1.845e0) + 6, 6) AS clip_end
            FROM (SELECT 'pog_' || run_id AS pog, p, CAST(30 + 10 * p AS INT) AS pwm, CAST(t AS INT) AS trial FROM keys_, (SELECT unnest(generate_series(0, 8)) AS p), (SELECT unnest(generate_series(0, 9)) AS t))""",
    "process": f"""SELECT 'pog_' || c.run_id AS pog, CASE WHEN idx < 2 THEN 30 ELSE 40 END AS pwm, idx % 2 AS trial, round((c.frame - ceil((0.25e0 + idx * 0.625e0) * {FPS})) / {FPS}, 6) AS time,
            round(coalesce(b.x, 0) * {SCALE}, 6) AS x, round(coalesce(b.y, 0) * {SCALE}, 6) AS y, coalesce(b.theta, 0) AS theta, 0 AS particle FROM clip c LEFT JOIN bot b ON b.run_id = c.run_id AND b.frame = c.frame""",
    "known_pogs": "SELECT 'pog_' || run_id AS pog, pwm, trial FROM keys_ WHERE run_id IN (0, 3, 7)",
    "axis_limits": f"SELECT run_id, round(max(x) * {SCALE}, 6) AS x_cm, round(max(y) * {SCALE}, 6) AS y_cm FROM det GROUP BY run_id",
    "experiment_grid": """SELECT pog, pwm, trial, CAST(p * 10 + trial AS INT) AS run_index, round(5.2e0 + (p * 10 + trial) * (6 + 1.845e0), 6) AS clip_start
            FROM (SELECT 'pog_' || run_id AS pog, p, CAST(30 + 10 * p AS INT) AS pwm, CAST(t AS INT) AS trial FROM keys_, (SELECT unnest(generate_series(0, 8)) AS p), (SELECT unnest(generate_series(0, 9)) AS t))""",
    "assign_runs": "SELECT run_id, frame, idx AS run_index, CASE WHEN idx < 2 THEN 30 ELSE 40 END AS pwm, idx % 2 AS trial, round(clip_time, 6) AS clip_time FROM clip",
    "interval_join": """SELECT t.run_id, frame, round(time, 6) AS time, round(trial * 0.25e0, 6) AS start, round(trial * 0.25e0 + 0.625e0, 6) AS "end"
            FROM trk t JOIN keys_ k ON t.run_id = k.run_id AND time >= trial * 0.25e0 AND time < trial * 0.25e0 + 0.625e0""",
    "missing_runs": "SELECT * FROM want WHERE (pog, pwm, trial) NOT IN (SELECT (pog, pwm, trial) FROM have)",
    "present_runs": "SELECT * FROM want WHERE (pog, pwm, trial) IN (SELECT (pog, pwm, trial) FROM have)",
    "run_names": "SELECT run_id, '/videos/pog_' || run_id || '_' || pwm || '_' || trial || '.csv' AS csv, 'pog_' || run_id AS pog, pwm, trial, CAST(run_id AS VARCHAR) AS short FROM keys_",
    "frame_set": "SELECT frame FROM det WHERE x > 1600 UNION SELECT frame FROM det WHERE y > 1700",
    "frames_in_set": "SELECT run_id, frame FROM det WHERE frame IN (SELECT frame FROM det GROUP BY frame HAVING count(*) % 2 = 1)",
    "img_flip_mask_subtract": """SELECT run_id, frame, count(*) AS n, CAST(sum(ub) AS BIGINT) AS sum_b, CAST(sum(ug) AS BIGINT) AS sum_g, CAST(sum(ur) AS BIGINT) AS sum_r,
            CAST(sum(ub * (15 - i)) AS BIGINT) AS sum_bi, CAST(sum(ur * j) AS BIGINT) AS sum_rj FROM pix WHERE (15 - i - 8) * (15 - i - 8) + (j - 8) * (j - 8) <= 36 GROUP BY run_id, frame""",
    "img_binarize": "SELECT run_id, frame, CAST(sum(up) AS BIGINT) AS sum_gray, count(*) FILTER (up > 45) AS n_white FROM pix GROUP BY run_id, frame",
    "img_angle": """SELECT run_id, frame, round(atan2(sum(v * i) / CAST(sum(v) AS DOUBLE) - any_value(ci), sum(v * j) / CAST(sum(v) AS DOUBLE) - any_value(cj)) * 180 / pi(), 6) AS theta
            FROM white WHERE v > 0 AND (i - ci) * (i - ci) + (j - cj) * (j - cj) <= 36 GROUP BY run_id, frame""",
    "contour_stats": "SELECT run_id, frame, contour, x, y, round(area, 6) AS area, round(perimeter, 6) AS perimeter FROM region",
    "contour_boxes": 'SELECT run_id, frame, 0 AS contour, min(i) AS top, min(j) AS "left", max(i) AS bottom, max(j) AS "right" FROM white WHERE v > 0 GROUP BY run_id, frame',
    "contour_crops": """SELECT run_id, frame, 0 AS contour, CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS BIGINT) AS n, CAST(sum(up) AS BIGINT) AS sum_gray, max(i) - min(i) AS height, max(j) - min(j) AS width
            FROM pix WHERE up > 0 GROUP BY run_id, frame""",
    "threshold_fallback": "SELECT run_id, frame, 0 AS rank, x, y, theta FROM bot",
    "detect": "SELECT run_id, e.frame, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(theta, 0) AS theta FROM e LEFT JOIN bot USING (run_id, frame)",
    "debug_views": """SELECT run_id, frame, CAST(sum((299 * (20 + (i + j) % 50 + ur - dim) + 587 * (20 + (i * 5 + j * 3) % 50 + ug - dim) + 114 * (20 + (i * 7 + j * 13) % 50 + ub - dim) + 500) // 1000) AS BIGINT) AS masked,
            CAST(sum(up) AS BIGINT) AS difference, CAST(255 * count(*) FILTER (up > 12) AS BIGINT) AS "binary"
            FROM (SELECT *, CASE WHEN on_ THEN 0 ELSE k % 3 END AS dim FROM pix) WHERE (i - 8) * (i - 8) + (j - 8) * (j - 8) <= 81 GROUP BY run_id, frame""",
    "contour_measures": "SELECT event_id, x, y, round(area, 6) AS area, round(perimeter, 6) AS perimeter FROM meas",
    "size_filter": "SELECT event_id FROM meas WHERE area > 30 AND area < 150 AND perimeter > 20 AND perimeter < 60",
    "wrong_count": "SELECT run_id, frame, CAST(0 AS BIGINT) AS n FROM trk WHERE s",
    "plot_quantity": "SELECT run_id, pwm, round(v, 6) AS value FROM vel JOIN keys_ USING (run_id)",
    "colour_scale": "SELECT min(pwm) AS low, max(pwm) AS high FROM msd JOIN keys_ USING (run_id)",
    "grid_cells": "SELECT pwm, CAST((n - 1) // 5 AS INT) AS row, CAST((n - 1) % 5 AS INT) AS column FROM (SELECT pwm, row_number() OVER (ORDER BY pwm) AS n FROM (SELECT DISTINCT pwm FROM keys_))",
    "msd_fit_line": "SELECT run_id, tau, round(intercept + slope * tau2, 6) AS line FROM msd JOIN fit USING (run_id) WHERE tau <= n_fit",
    "circle_polyline": """SELECT run_id, CAST(p AS INT) AS p, round(xc + radius * cos(p * (2 * pi() / 11)), 4) AS x, round(yc + radius * sin(p * (2 * pi() / 11)), 4) AS y
            FROM kasa, (SELECT unnest(generate_series(0, 11)) AS p) WHERE radius IS NOT NULL""",
    "arrows": "SELECT run_id, frame, CAST(trunc(x + 40e0 * cos(radians(theta))) AS INT) AS x_end, CAST(trunc(y + 40e0 * sin(radians(theta))) AS INT) AS y_end FROM det",
    "trajectories": "SELECT run_id, particle, round(CAST(frame AS DOUBLE), 6) AS frame, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(y AS DOUBLE), 6) AS y FROM link",
}


#: Gauss-Newton steps from the algebraic fit to the circle of least spread of distances.
ROUNDS = 8
STEPS["fit0"] = "SELECT run_id, xc AS cx, yc AS cy FROM kasa"
for _k in range(ROUNDS):
    STEPS[f"jac{_k}"] = f"""SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS r, u - avg(u) OVER (PARTITION BY run_id) AS u, v - avg(v) OVER (PARTITION BY run_id) AS v
            FROM (SELECT *, (cx - x) / r AS u, (cy - y) / r AS v FROM (SELECT m.*, cx, cy, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM mid m JOIN fit{_k} USING (run_id)))"""
    STEPS[f"fit{_k + 1}"] = f"""SELECT run_id, cx + (uv * gv - vv * gu) / (uu * vv - uv * uv) AS cx, cy + (uv * gu - uu * gv) / (uu * vv - uv * uv) AS cy
            FROM fit{_k} JOIN (SELECT run_id, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(r * u) AS gu, sum(r * v) AS gv FROM jac{_k} GROUP BY run_id) USING (run_id)"""
STEPS["circle"] = f"""SELECT run_id, any_value(t_min) AS t_min, any_value(t_max) AS t_max, any_value(cx) AS xc, any_value(cy) AS yc, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS radius_, CAST(count(*) AS INT) AS n
            FROM mid JOIN fit{ROUNDS} USING (run_id) GROUP BY run_id"""
#: Queries over the arcs in place of cleaned walks.
ON_ARCS = {
    "circle_fit": "SELECT run_id, round(t_min, 4) AS t_min, round(t_max, 4) AS t_max, round(xc, 4) AS xc, round(yc, 4) AS yc, round(radius_, 4) AS R, n FROM circle",
    "physics": """SELECT run_id, pwm, trial, round(omega_fft, 4) AS omega_fft, round(omega_noise, 4) AS omega_noise, round(v, 4) AS v_msd, round(radius_, 4) AS R, round(v / radius_, 4) AS omega_ucm
            FROM fft_ JOIN (SELECT run_id, abs(avg(g)) AS omega_noise FROM grad GROUP BY run_id) USING (run_id) JOIN vel USING (run_id) JOIN circle USING (run_id) JOIN keys_ USING (run_id)""",
}


def _sql(final: str, steps: dict[str, str] = STEPS) -> str:
    """The query with the steps that it needs, each after those that it reads."""
    import re

    order: list[str] = []

    def add(text: str, on: tuple[str, ...]) -> None:
        for name in steps:
            if name not in order and name not in on and re.search(rf"\b{name}\b", text):
                add(steps[name], (*on, name))
                order.append(name)

    add(final, ())
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({steps[n]})" for n in order) + "\n" + final


ORACLES = {name: _sql(final) for name, final in FINAL.items()}
ORACLES |= {name: _sql(final, STEPS | {"cln": "SELECT * FROM arc"}) for name, final in ON_ARCS.items()}
ORACLES["physics_reasons_short"] = _sql(FINAL["physics_reasons"], STEPS | {"uncut": STEPS["cln"], "cln": "SELECT * FROM uncut WHERE run_id % 3 <> 0 OR rn < 12 + run_id % 20"})
#: Clips as videos of their own, with two bots a frame or a row of zeros, and a range of 8.
TWO_BOTS = {
    "spot": f"""SELECT *, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY x, y, theta) AS INT) AS i
            FROM (SELECT c.run_id * 10 + idx AS video_id, c.run_id, idx, CAST(c.frame - ceil((0.25e0 + idx * 0.625e0) * {FPS}) AS INT) AS frame, coalesce(f.x, 0) AS x, coalesce(f.y, 0) AS y, coalesce(f.theta, 0) AS theta
                  FROM clip c JOIN e ON e.run_id = c.run_id AND e.frame = c.frame LEFT JOIN found_ f ON f.k = e.k AND f.p = e.frame % 6 AND e.event_type <> 'error')""",
    "step_": STEPS["step_"].replace("80000", "128").replace("40000", "64"),
}
ORACLES["process_two"] = _sql(
    f"""SELECT 'pog_' || run_id AS pog, CASE WHEN idx < 2 THEN 30 ELSE 40 END AS pwm, idx % 2 AS trial, round(frame / {FPS}, 6) AS time, round(x * {SCALE}, 6) AS x, round(y * {SCALE}, 6) AS y, theta, particle
            FROM spot JOIN numbered USING (video_id, frame, i)""",
    STEPS | TWO_BOTS,
)
