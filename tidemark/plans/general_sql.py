"""The SQL of p2 to p6, written apart from the operators: plain window functions, joins and day lists over the raw rows."""

_ROWS = """
limited AS (
  SELECT s.*, l.out_of_orderness_millis AS delay, l.window_size_millis AS size, l.allowed_lateness_millis AS allowed
  FROM stream_table s LEFT JOIN bounded_out_of_orderness_watermarks l ON s.job_id = l.job_id),
marks AS (
  SELECT job_id, batch_id, MAX("timestamp") AS mark FROM stream_table WHERE "timestamp" IS NOT NULL GROUP BY job_id, batch_id),
before AS (
  SELECT job_id, batch_id, MAX(mark) OVER (PARTITION BY job_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM marks),
placed AS (
  SELECT r.*, ("timestamp" // size + 1) * size AS e, b.mark - delay - 1 AS w
  FROM limited r LEFT JOIN before b ON r.job_id = b.job_id AND r.batch_id = b.batch_id),
arrived AS (
  SELECT *, CASE WHEN e IS NULL THEN 'untimed' WHEN w IS NULL OR e > w THEN 'on_time' WHEN e + allowed > w THEN 'late' ELSE 'diverted' END AS arrival
  FROM placed),
named AS (SELECT * FROM arrived WHERE name IS NOT NULL AND name <> '')
"""

_SAVED = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY application_name, application_id, job_id, task_number, operator_id, checkpoint_id ORDER BY id DESC) AS rn FROM rlink_ck)
  WHERE rn = 1),
pairs AS (SELECT application_name, application_id, COUNT(DISTINCT (job_id, operator_id)) AS pairs FROM latest GROUP BY ALL),
each_pair AS (
  SELECT application_name, application_id, checkpoint_id, job_id, operator_id, COUNT(DISTINCT task_number) AS tasks, MAX(num_tasks) AS num_tasks,
    MIN(CASE WHEN completed_checkpoint_id > 0 THEN completed_checkpoint_id END) AS back
  FROM latest GROUP BY ALL),
whole AS (
  SELECT application_name, application_id, checkpoint_id, COUNT(*) FILTER (WHERE tasks = num_tasks) AS complete, MIN(back) AS back
  FROM each_pair GROUP BY ALL),
best AS (
  SELECT w.application_name, w.application_id, MAX(checkpoint_id) AS checkpoint_id
  FROM whole w JOIN pairs p ON w.application_name = p.application_name AND w.application_id = p.application_id AND complete = pairs GROUP BY ALL),
restart AS (
  SELECT b.application_name, b.application_id, COALESCE(w.back, w.checkpoint_id) AS checkpoint_id
  FROM best b JOIN whole w ON b.application_name = w.application_name AND b.application_id = w.application_id AND b.checkpoint_id = w.checkpoint_id),
handles AS (
  SELECT TRY_CAST(handle AS JSON) AS h FROM latest l JOIN restart r
    ON l.application_name = r.application_name AND l.application_id = r.application_id AND l.checkpoint_id = r.checkpoint_id
  WHERE job_id = 0 AND operator_id = 0),
saved AS (
  SELECT h->>'topic' AS topic, CAST(h->>'partition' AS INTEGER) AS "partition", MIN(CAST(h->>'offset' AS BIGINT)) AS saved
  FROM handles WHERE h->>'offset' IS NOT NULL GROUP BY 1, 2),
delivered AS (
  SELECT c.topic, c."partition", m."offset", m.delivery_id FROM kafka_message m JOIN consumer_range c ON m.range_id = c.range_id WHERE m."offset" IS NOT NULL),
pending AS (
  SELECT d.topic, d."partition", d."offset", MIN(delivery_id) AS delivery_id
  FROM delivered d LEFT JOIN saved s ON d.topic = s.topic AND d."partition" = s."partition" WHERE s.saved IS NULL OR d."offset" > s.saved GROUP BY ALL)
"""

_DAYS = """
timed AS (SELECT name, "timestamp" // 86400000 AS day, value FROM stream_table WHERE name <> '' AND "timestamp" IS NOT NULL),
spans AS (SELECT name, MIN(day) AS lo, MAX(day) AS hi FROM timed GROUP BY name),
days AS (SELECT name, UNNEST(RANGE(lo, hi + 1)) AS day FROM spans),
own AS (SELECT name, day, COUNT(*) AS n_rows, COUNT(value) AS n, COALESCE(SUM(value), 0) AS total FROM timed GROUP BY name, day),
filled AS (SELECT d.name, d.day, COALESCE(n_rows, 0) AS n_rows, COALESCE(n, 0) AS n, COALESCE(total, 0) AS total FROM days d LEFT JOIN own o ON d.name = o.name AND d.day = o.day)
"""

# the live form: micro-batches of 240 batch ids
_MICRO = """
limited AS (
  SELECT s.*, batch_id // 240 AS micro, l.out_of_orderness_millis AS delay, l.window_size_millis AS size, l.allowed_lateness_millis AS allowed
  FROM stream_table s LEFT JOIN bounded_out_of_orderness_watermarks l ON s.job_id = l.job_id)
"""

_LIVE = f"""{_MICRO},
micros AS (SELECT DISTINCT micro FROM limited),
per_micro AS (SELECT j.job_id, m.micro, MAX(CASE WHEN l.micro = m.micro THEN l."timestamp" END) AS mark FROM (SELECT DISTINCT job_id FROM limited) j, micros m LEFT JOIN limited l ON l.job_id = j.job_id AND l.micro = m.micro GROUP BY ALL),
after AS (SELECT job_id, micro, MAX(mark) OVER (PARTITION BY job_id ORDER BY micro) AS mark FROM per_micro),
before AS (SELECT job_id, micro, MAX(mark) OVER (PARTITION BY job_id ORDER BY micro ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM per_micro),
placed AS (SELECT r.*, ("timestamp" // size + 1) * size AS e, b.mark - delay - 1 AS w FROM limited r LEFT JOIN before b ON r.job_id = b.job_id AND r.micro = b.micro),
arrived AS (SELECT *, CASE WHEN e IS NULL THEN 'untimed' WHEN w IS NULL OR e > w THEN 'on_time' WHEN e + allowed > w THEN 'late' ELSE 'diverted' END AS arrival FROM placed)
"""

_FOLD = "CAST(SUM(value) AS BIGINT) AS sum_value, MAX(value) AS max_value, MIN(value) AS min_value, COUNT(*) AS row_count"

SQL = {
    "p2_found": f"WITH {_ROWS} SELECT row_id FROM arrived WHERE arrival = 'late'",
    "p2_windows": f"""WITH {_ROWS} SELECT job_id, name, CAST(e - size AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end,
        {', '.join(f"CAST(SUM(value) FILTER (WHERE {c}) AS BIGINT) AS {t}_sum_value, MAX(value) FILTER (WHERE {c}) AS {t}_max_value, MIN(value) FILTER (WHERE {c}) AS {t}_min_value, COUNT(*) FILTER (WHERE {c}) AS {t}_row_count" for t, c in (('first', "arrival = 'on_time'"), ('final', 'TRUE')))}
        FROM named WHERE arrival IN ('on_time', 'late') GROUP BY job_id, name, e, size""",
    # the table of first results that comes with the data
    "p2_first_fired": "SELECT DISTINCT job_id, name, window_start, window_end, sum_value, max_value, min_value, row_count FROM time_window",
    "p2_revisions": f"""WITH {_ROWS},
        parts AS (SELECT job_id, name, e, size, CASE WHEN arrival = 'late' THEN batch_id END AS batch, SUM(value) AS s, MAX(value) AS mx, MIN(value) AS mn, COUNT(*) AS n
          FROM named WHERE arrival IN ('on_time', 'late') GROUP BY ALL)
        SELECT job_id, name, CAST(e - size AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, batch,
          COUNT(batch) OVER w AS revision, CAST(SUM(s) OVER w AS BIGINT) AS sum_value, MAX(mx) OVER w AS max_value, MIN(mn) OVER w AS min_value, CAST(SUM(n) OVER w AS BIGINT) AS row_count
        FROM parts WINDOW w AS (PARTITION BY job_id, name, e ORDER BY batch NULLS FIRST ROWS UNBOUNDED PRECEDING)""",
    "p2_diverted": f"WITH {_ROWS} SELECT row_id, arrival FROM arrived WHERE arrival IN ('diverted', 'untimed')",
    "p2_by_task": f"""WITH {_ROWS},
        task_marks AS (SELECT job_id, task_number, batch_id, MAX("timestamp") AS mark FROM stream_table WHERE "timestamp" IS NOT NULL GROUP BY ALL),
        asked AS (SELECT DISTINCT job_id, batch_id FROM stream_table),
        by_task AS (
          SELECT a.job_id, a.batch_id, t.task_number, MAX(t.mark) AS mark, MAX(t.batch_id) AS seen
          FROM asked a JOIN task_marks t ON t.job_id = a.job_id AND t.batch_id < a.batch_id GROUP BY ALL),
        lows AS (SELECT job_id, batch_id, MIN(mark) AS mark FROM by_task WHERE batch_id - seen <= 48 GROUP BY ALL),
        judged AS (
          SELECT p.job_id, p.e, p.allowed, l.mark - p.delay - 1 AS w FROM placed p LEFT JOIN lows l ON p.job_id = l.job_id AND p.batch_id = l.batch_id)
        SELECT job_id, CASE WHEN e IS NULL THEN 'untimed' WHEN w IS NULL OR e > w THEN 'on_time' WHEN e + allowed > w THEN 'late' ELSE 'diverted' END AS arrival, COUNT(*) AS n
        FROM judged GROUP BY ALL""",
    "p2_live_windows": f"""WITH {_LIVE}, named AS (SELECT * FROM arrived WHERE name IS NOT NULL AND name <> '' AND arrival IN ('on_time', 'late'))
        SELECT job_id, name, CAST(e - size AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, {_FOLD},
          COUNT(DISTINCT CASE WHEN arrival = 'late' AND micro > COALESCE(first_fired, 1000000) THEN micro END) AS corrections
        FROM (SELECT n.*, MIN(micro) OVER (PARTITION BY job_id, name, e) AS shown,
            GREATEST(MIN(micro) OVER (PARTITION BY job_id, name, e), (SELECT MIN(a.micro) FROM after a WHERE a.job_id = n.job_id AND a.mark - n.delay - 1 >= n.e)) AS first_fired FROM named n)
        GROUP BY job_id, name, e, size""",
    "p2_live_arrivals": f"""WITH {_MICRO},
        task_marks AS (SELECT job_id, task_number, micro, MAX("timestamp") AS mark FROM limited WHERE "timestamp" IS NOT NULL AND job_id IS NOT NULL GROUP BY ALL),
        asked AS (SELECT j.job_id, m.micro FROM (SELECT DISTINCT job_id FROM task_marks) j, (SELECT DISTINCT micro FROM limited) m),
        by_task AS (SELECT a.job_id, a.micro, t.task_number, MAX(t.mark) AS mark, MAX(t.micro) AS seen FROM asked a JOIN task_marks t ON t.job_id = a.job_id AND t.micro < a.micro GROUP BY ALL),
        lows AS (SELECT job_id, micro, MIN(mark) AS mark FROM (SELECT *, MAX(seen) OVER (PARTITION BY job_id, micro) AS newest FROM by_task) WHERE seen >= LEAST(micro - 2, newest) GROUP BY ALL),
        low AS (SELECT job_id, micro, MAX(mark) OVER (PARTITION BY job_id ORDER BY micro) AS mark FROM lows),
        judged AS (SELECT r.row_id, "timestamp" AS ts, ("timestamp" // size + 1) * size AS e, allowed, l.mark - delay - 1 AS w FROM limited r LEFT JOIN low l ON r.job_id = l.job_id AND r.micro = l.micro)
        SELECT row_id, CASE WHEN e IS NULL THEN 'untimed' WHEN w IS NULL OR e > w THEN 'on_time' WHEN e + allowed > w THEN 'late' ELSE 'diverted' END AS arrival, COALESCE(ts < w, FALSE) AS below FROM judged""",
    "p3_found": f'WITH {_SAVED} SELECT topic, "partition", "offset" FROM pending',
    "p3_saved_offsets": f'WITH {_SAVED} SELECT topic, "partition", saved FROM saved',
    "p3_pending_messages": f'WITH {_SAVED} SELECT topic, "partition", "offset", delivery_id FROM pending',
    "p3_changed_states": f"""WITH
        {', '.join(f"{t} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY application_name, application_id, job_id, task_number, operator_id ORDER BY checkpoint_id DESC, id DESC) AS rn FROM rlink_ck WHERE {c}) WHERE rn = 1)" for t, c in (('old', 'checkpoint_id <= 1421798400000'), ('new', 'TRUE')))}
        SELECT n.application_name, n.application_id, n.job_id, n.task_number, n.operator_id, n.checkpoint_id, n.completed_checkpoint_id, n.handle,
          CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS change
        FROM new n LEFT JOIN old o ON n.application_name = o.application_name AND n.application_id = o.application_id AND n.job_id = o.job_id AND n.task_number = o.task_number AND n.operator_id = o.operator_id
        WHERE o.id IS NULL OR (n.checkpoint_id, n.completed_checkpoint_id, n.handle) IS DISTINCT FROM (o.checkpoint_id, o.completed_checkpoint_id, o.handle)""",
    "p3_appended": """WITH span AS (SELECT MIN(batch_id) AS lo, MAX(batch_id) + 1 AS hi FROM kafka_message),
        d AS (SELECT c.topic, c."partition", m."offset", BOOL_AND(m.batch_id >= lo + (hi - lo) * 4 // 5) AS fresh
          FROM kafka_message m JOIN consumer_range c ON m.range_id = c.range_id, span WHERE m."offset" IS NOT NULL GROUP BY ALL)
        SELECT topic, "partition", "offset" FROM d WHERE fresh""",
    "p4_found": "SELECT name FROM stream_table WHERE name <> '' GROUP BY name HAVING COUNT(*) * 100 >= (SELECT COUNT(*) FROM stream_table)",
    "p4_per_name": "SELECT name, COUNT(*) AS row_count, COUNT(value) AS value_count, CAST(SUM(value) AS BIGINT) AS sum_value, MAX(value) AS max_value, MIN(value) AS min_value FROM stream_table GROUP BY name",
    "p5_found": """SELECT c.topic, c."partition", m."offset" FROM kafka_message m JOIN consumer_range c ON m.range_id = c.range_id
        WHERE m."offset" IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""",
    "p5_unique": """SELECT MIN(m.delivery_id) AS delivery_id FROM kafka_message m JOIN consumer_range c ON m.range_id = c.range_id
        GROUP BY c.topic, c."partition", m."offset", CASE WHEN m."offset" IS NULL THEN m."key" END, CASE WHEN m."offset" IS NULL THEN m.payload END, CASE WHEN m."offset" IS NULL THEN m."timestamp" END""",
    "p6_found": f"WITH {_DAYS} SELECT name, STRFTIME(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day FROM filled WHERE n_rows = 0",
    "p6_undated": """SELECT name, 'untimed' AS reason, COUNT(*) AS "rows", COUNT(value) AS n, CAST(SUM(value) AS BIGINT) AS total FROM stream_table WHERE "timestamp" IS NULL GROUP BY name""",
    "p6_rolling": f"""WITH {_DAYS} SELECT name, STRFTIME(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, n_rows AS rows_today,
        {', '.join(f"CAST(SUM(total) OVER w{k} AS BIGINT) AS total_{k}d, CAST(SUM(n) OVER w{k} AS BIGINT) AS n_{k}d, CAST(SUM(total) OVER w{k} AS DOUBLE) / NULLIF(SUM(n) OVER w{k}, 0) AS avg_{k}d" for k in (7, 30))}
        FROM filled WINDOW w7 AS (PARTITION BY name ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY name ORDER BY day ROWS 29 PRECEDING)""",
}
