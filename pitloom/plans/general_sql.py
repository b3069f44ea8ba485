"""The same results as plans/general.py in DuckDB's SQL, by plain joins."""

from __future__ import annotations

_VALUES = """
v AS (
  SELECT 'stg_prices' AS t, 'low' AS c, source, load_id, ticker AS b, CAST(low AS DOUBLE) AS x, low IS NULL AS hole, FALSE AS bad,
         CAST(low AS VARCHAR) AS txt FROM stg_prices
  UNION ALL
  SELECT 'stg_prices', 'volume', source, load_id, ticker, CAST(volume AS DOUBLE), volume IS NULL, FALSE, CAST(volume AS VARCHAR) FROM stg_prices
  UNION ALL
  SELECT 'drift_features', 'psi', source, report_id, '', CASE WHEN regexp_full_match(psi, '-?[0-9]+[.][0-9]+') THEN CAST(psi AS DOUBLE) END,
         psi IS NULL, psi IS NOT NULL AND NOT regexp_full_match(psi, '-?[0-9]+[.][0-9]+'), psi FROM drift_features
),
loads AS (
  SELECT t, c, source, load_id, count(*) AS n_rows, count(*) FILTER (hole) AS n_null, count(*) FILTER (bad) AS n_unreadable,
         count(x) AS n_values, count(DISTINCT x) AS n_distinct, min(x) AS least, max(x) AS most
  FROM v GROUP BY ALL
)"""

_MASKS = """
m AS (
  SELECT t, c, source, load_id,
         regexp_replace(regexp_replace(regexp_replace(txt, '\\p{L}+', 'a', 'g'), '[0-9]+', '9', 'g'), '\\s+', '_', 'g') AS mask, count(*) AS n
  FROM v WHERE NOT hole GROUP BY ALL
),
prof AS (
  SELECT *, sum(n) OVER (PARTITION BY t, c, source, load_id) AS n_load, sum(n) OVER (PARTITION BY t, c, source) AS n_source,
         sum(n) OVER (PARTITION BY t, c, source, mask) AS n_mask
  FROM m
)"""

_SPIKE = """
bars AS (
  SELECT source, ticker, trade_date,
         max_by(open, (load_id, row_id)) FILTER (open IS NOT NULL) AS open, max_by(close, (load_id, row_id)) FILTER (close IS NOT NULL) AS close,
         max_by(high, (load_id, row_id)) FILTER (high IS NOT NULL) AS high,
         CAST(max_by(volume, (load_id, row_id)) FILTER (volume IS NOT NULL) AS DOUBLE) AS volume
  FROM stg_prices WHERE trade_date IS NOT NULL GROUP BY ALL
),
long AS (
  SELECT source, ticker, trade_date, 'close' AS field, close AS x, close <= 0 AS impossible FROM bars
  UNION ALL SELECT source, ticker, trade_date, 'high', high, high < open OR high < close FROM bars
  UNION ALL SELECT source, ticker, trade_date, 'volume', volume, volume < 0 FROM bars
),
hang AS (
  SELECT *, count(*) OVER (PARTITION BY source, ticker, field, island) AS run
  FROM (SELECT *, sum(1 - same) OVER (PARTITION BY source, ticker, field ORDER BY trade_date) AS island
        FROM (SELECT *, CAST(coalesce(x = lag(x) OVER w, FALSE) AS INT) AS same FROM long WINDOW w AS (PARTITION BY source, ticker, field ORDER BY trade_date)))
),
moves AS (SELECT source, ticker, field, avg(same) AS still FROM hang GROUP BY ALL),
pos AS (
  SELECT source, ticker, trade_date, field, ln(x) AS x, lag(ln(x)) OVER w AS l, lag(ln(x), 2) OVER w AS l2,
         lead(ln(x)) OVER w AS r, lead(ln(x), 2) OVER w AS r2
  FROM long WHERE x > 0 WINDOW w AS (PARTITION BY source, ticker, field ORDER BY trade_date)
),
stands AS (
  SELECT source, ticker, trade_date, field, x - l AS change, date_trunc('month', trade_date) AS month,
         greatest(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN x - greatest(l, r) END,
                  CASE WHEN l IS NOT NULL AND r2 IS NOT NULL THEN least(x, r) - greatest(l, r2) END,
                  CASE WHEN l2 IS NOT NULL AND r IS NOT NULL THEN least(x, l) - greatest(l2, r) END) AS up,
         greatest(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN least(l, r) - x END,
                  CASE WHEN l IS NOT NULL AND r2 IS NOT NULL THEN least(l, r2) - greatest(x, r) END,
                  CASE WHEN l2 IS NOT NULL AND r IS NOT NULL THEN least(l2, r) - greatest(x, l) END) AS down
  FROM pos
),
wide AS (
  SELECT *, CASE WHEN count(change) OVER mo >= 8 THEN greatest(0.0005, quantile_disc(change, 0.75) OVER mo - quantile_disc(change, 0.25) OVER mo) ELSE series_range END AS month_range,
         CASE WHEN count(change) OVER wd >= 8 THEN greatest(0.0005, quantile_disc(change, 0.75) OVER wd - quantile_disc(change, 0.25) OVER wd) ELSE series_range END AS weekday_range
  FROM (SELECT *, greatest(0.0005, quantile_disc(change, 0.75) OVER se - quantile_disc(change, 0.25) OVER se) AS series_range FROM stands WINDOW se AS (PARTITION BY source, ticker, field))
  WINDOW mo AS (PARTITION BY source, ticker, field, month), wd AS (PARTITION BY source, ticker, field, isodow(trade_date))
),
cases AS (
  SELECT source, ticker, trade_date, field, 'impossible' AS reason FROM long WHERE impossible
  UNION ALL SELECT h.source, h.ticker, trade_date, h.field, 'hangs' FROM hang h JOIN moves m USING (source, ticker, field) WHERE same = 1 AND run >= 7 AND still < 0.5
  UNION ALL SELECT source, ticker, trade_date, field, 'spike' FROM wide
  WHERE CASE field
    WHEN 'close' THEN greatest(up, down) > greatest(5.0 * series_range, 2.5 * month_range, 3.0 * weekday_range)
    WHEN 'high' THEN up > greatest(6.0 * series_range, 3.0 * month_range, 3.6 * weekday_range)
    ELSE up > greatest(2.7 * series_range, 0.5 * month_range, 1.6 * weekday_range, 1.82) END
)"""

_DAILY = """
vol AS (SELECT ticker, trade_date AS day, coalesce(x, 0) AS x FROM (
  SELECT ticker, trade_date, max_by(volume, loaded_at) AS x FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY loaded_at DESC, volume DESC NULLS LAST) AS k FROM fct_prices_daily) WHERE k = 1 GROUP BY ALL)),
ret AS (SELECT ticker, trade_date AS day, coalesce(x, 0) AS x FROM (
  SELECT ticker, trade_date, CAST(round(log_return * 1000000) AS BIGINT) AS x FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY loaded_at DESC, log_return DESC NULLS LAST) AS k FROM fct_returns_daily) WHERE k = 1)),
daily AS (SELECT 'volume' AS measure, * FROM vol UNION ALL SELECT 'log_return', * FROM ret),
span AS (SELECT measure, ticker, min(day) AS f, max(day) AS l FROM daily GROUP BY ALL),
cal AS (SELECT measure, ticker, f, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
run AS (
  SELECT measure, ticker, f, day, CAST(sum(coalesce(x, 0)) OVER (PARTITION BY measure, ticker ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS s7,
         CAST(sum(coalesce(x, 0)) OVER (PARTITION BY measure, ticker ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS s30
  FROM cal LEFT JOIN daily USING (measure, ticker, day)
)"""

_CHANGES = """
rec AS (
  SELECT DISTINCT 'manifest' AS t, source AS e, manifest_no AS s, CAST(manifest_no AS VARCHAR) AS sn, ticker AS r, lower(latest_hash) AS v FROM manifest
  UNION ALL
  SELECT DISTINCT 'stg_macro_series', series_id, date_diff('day', DATE '1970-01-01', vintage_date), CAST(vintage_date AS VARCHAR), CAST(observation_date AS VARCHAR), CAST(value AS VARCHAR)
  FROM stg_macro_series
),
st AS (SELECT t, e, s, sn, lag(s) OVER (PARTITION BY t, e ORDER BY s) AS p FROM (SELECT DISTINCT t, e, s, sn FROM rec)),
cur AS (SELECT t, e, s, sn, r, v FROM st JOIN rec USING (t, e, s, sn) WHERE p IS NOT NULL),
old AS (SELECT st.t, st.e, st.s, st.sn, rec.r, rec.v FROM st JOIN rec ON st.t = rec.t AND st.e = rec.e AND st.p = rec.s),
bars AS (SELECT source, ticker, trade_date, load_id, max(adj_close) AS a FROM stg_prices GROUP BY ALL),
again AS (SELECT *, lag(a) OVER (PARTITION BY source, ticker, trade_date ORDER BY load_id) AS b FROM bars),
ch AS (
  SELECT coalesce(c.t, o.t) AS table_name, coalesce(c.e, o.e) AS entity, coalesce(c.sn, o.sn) AS snapshot, coalesce(c.r, o.r) AS record,
         CASE WHEN o.r IS NULL THEN 'added' WHEN c.r IS NULL THEN 'removed' ELSE 'changed' END AS change,
         CASE WHEN o.r IS NULL OR c.r IS NULL THEN '' WHEN coalesce(c.t, o.t) = 'manifest' THEN 'latest_hash' ELSE 'value' END AS fields
  FROM cur c FULL JOIN old o ON c.t = o.t AND c.e = o.e AND c.s = o.s AND c.r = o.r
  WHERE o.r IS NULL OR c.r IS NULL OR c.v IS DISTINCT FROM o.v
  UNION ALL
  SELECT 'stg_prices', source, CAST(load_id AS VARCHAR), ticker || ' ' || CAST(trade_date AS VARCHAR), 'changed', 'adj_close'
  FROM again WHERE round(abs(a - b), 8) >= 0.0001
)"""

_VERSIONS = """
snap AS (
  SELECT ticker, snapshot_date, is_benchmark, valid_from, valid_to, nullif(trim(regexp_replace(lower(sector), '[^a-z]+', ' ', 'g')), '') AS sector
  FROM ticker_metadata QUALIFY row_number() OVER (PARTITION BY ticker, snapshot_date ORDER BY delivered_at DESC) = 1
),
filled AS (SELECT * REPLACE (last_value(sector IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS sector) FROM snap),
brk AS (
  SELECT *, CAST(row_number() OVER w = 1 OR sector IS DISTINCT FROM lag(sector) OVER w OR is_benchmark IS DISTINCT FROM lag(is_benchmark) OVER w
            OR (valid_to IS NULL AND lag(valid_to) OVER w IS NOT NULL) AS INT) AS b
  FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY snapshot_date)
),
num AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY snapshot_date) AS version FROM brk),
ver AS (
  SELECT ticker, CAST(version AS BIGINT) AS version, any_value(sector) AS sector, any_value(is_benchmark) AS is_benchmark,
         arg_min(coalesce(valid_from, snapshot_date), snapshot_date) AS valid_from, arg_min(valid_to, snapshot_date) FILTER (valid_to IS NOT NULL) AS stated
  FROM num GROUP BY ticker, version
),
hist AS (
  SELECT ticker, version, sector, is_benchmark, valid_from,
         coalesce(stated, CAST(lead(valid_from) OVER (PARTITION BY ticker ORDER BY version) - INTERVAL 1 DAY AS DATE)) AS valid_to FROM ver
)"""

_GRID = """
rd AS (
  SELECT series_id, CASE isodow(trade_date) WHEN 6 THEN trade_date + 2 WHEN 7 THEN trade_date + 1 ELSE trade_date END AS day, trade_date AS dated, row_id, value
  FROM int_macro_daily
),
sp AS (SELECT series_id, min(day) AS f, max(day) AS l FROM rd GROUP BY ALL),
gd AS (SELECT series_id, day FROM (SELECT series_id, CAST(unnest(generate_series(f, l, INTERVAL 1 DAY)) AS DATE) AS day FROM sp) WHERE isodow(day) < 6),
one AS (SELECT series_id, day, dated, value FROM rd WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, dated ORDER BY row_id DESC) = 1),
cell AS (SELECT series_id, day, avg(value) AS value, count(*) AS n FROM one GROUP BY ALL),
grd AS (
  SELECT series_id, day AS trade_date, value, coalesce(n, 0) / CASE WHEN isodow(day) = 1 THEN 3 ELSE 1 END AS coverage,
         last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day) AS filled, n IS NULL AS missing
  FROM gd LEFT JOIN cell USING (series_id, day)
)"""

_WEEKS = """
wr AS (
  SELECT series_id, trade_date AS a, value, least(trade_date + 10, coalesce(lead(trade_date) OVER (PARTITION BY series_id ORDER BY trade_date), DATE '9999-12-31')) AS b
  FROM (SELECT * FROM int_macro_daily WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, trade_date ORDER BY row_id DESC) = 1)
),
wg AS (SELECT series_id, CAST(unnest(generate_series(date_trunc('week', f), date_trunc('week', l), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT series_id, min(trade_date) AS f, max(trade_date) AS l FROM int_macro_daily GROUP BY ALL)),
wc AS (
  SELECT g.series_id, week, sum(value * (least(b, week + 7) - greatest(a, week))) / sum(least(b, week + 7) - greatest(a, week)) AS value, sum(least(b, week + 7) - greatest(a, week)) FILTER (a IS NOT NULL) AS w
  FROM wg g LEFT JOIN wr r ON g.series_id = r.series_id AND r.a < g.week + 7 AND r.b > g.week GROUP BY ALL
)"""

_KNOWN = """
vt AS (SELECT DISTINCT series_id, vintage_date AS kv FROM stg_macro_series),
ev AS (SELECT e.*, kv FROM int_macro_daily e ASOF LEFT JOIN vt ON e.series_id = vt.series_id AND e.trade_date >= vt.kv),
ob AS (SELECT DISTINCT series_id, vintage_date, observation_date AS ko, value AS kx FROM stg_macro_series),
mk AS (
  SELECT e.*, ko, kx FROM ev e ASOF LEFT JOIN ob ON e.series_id = ob.series_id AND e.kv = ob.vintage_date AND e.trade_date >= ob.ko
),
fl AS (
  SELECT ticker, namespace, tag, filed AS kf, value AS kx, period_end AS kp FROM stg_sec_facts
  WHERE form IN ('10-K', '10-Q') AND value IS NOT NULL AND period_end <= filed
  QUALIFY row_number() OVER (PARTITION BY ticker, namespace, tag, filed ORDER BY period_end DESC, coalesce(period_end - period_start, -1) DESC, value DESC) = 1
),
fk AS (
  SELECT e.*, kf, kx, kp FROM int_fundamentals_pit e
  ASOF LEFT JOIN fl ON e.ticker = fl.ticker AND e.namespace = fl.namespace AND e.tag = fl.tag AND e.trade_date >= fl.kf
),
kn AS (
  SELECT 'int_macro_daily' AS table_name, row_id, CASE WHEN ko IS NOT NULL THEN kv END AS known_date, ko AS known_period, kx AS known_value,
         vintage_date IS NOT DISTINCT FROM (CASE WHEN ko IS NOT NULL THEN kv END) AND observation_date IS NOT DISTINCT FROM ko AND value IS NOT DISTINCT FROM kx AS agrees FROM mk
  UNION ALL
  SELECT 'int_fundamentals_pit', row_id, kf, kp, kx, filed_used IS NOT DISTINCT FROM kf AND period_end_used IS NOT DISTINCT FROM kp AND value IS NOT DISTINCT FROM kx FROM fk
)"""

SQL = {
    "p1_found": f"""WITH {_VALUES},
oth AS (
  SELECT a.t, a.c, a.source, a.load_id, sum(b.n_rows) AS n_rows, sum(b.n_null) AS n_null, sum(b.n_values) AS n_values, sum(b.n_distinct) AS n_distinct
  FROM loads a JOIN loads b ON a.t = b.t AND a.c = b.c AND a.source = b.source AND a.load_id <> b.load_id GROUP BY ALL
),
grp AS (SELECT DISTINCT t, c, source, b, load_id FROM v WHERE x IS NOT NULL),
med AS (
  SELECT g.t, g.c, g.source, g.b, g.load_id, quantile_cont(o.x, 0.5) AS med
  FROM grp g JOIN v o ON g.t = o.t AND g.c = o.c AND g.source = o.source AND g.b = o.b AND g.load_id <> o.load_id AND o.x IS NOT NULL GROUP BY ALL
),
far AS (
  SELECT t, c, source, load_id, count(*) FILTER (x > 5 * med OR x < med / 5) AS n_far FROM v JOIN med USING (t, c, source, b, load_id) WHERE x IS NOT NULL GROUP BY ALL
)
SELECT DISTINCT t AS table_name, c AS column_name, load_id, issue FROM (
  SELECT l.t, l.c, l.load_id, 'null_rate' AS issue FROM loads l JOIN oth o USING (t, c, source, load_id) WHERE l.n_null / l.n_rows - o.n_null / o.n_rows >= 0.105
  UNION ALL SELECT t, c, load_id, 'pattern' FROM loads WHERE n_unreadable > 0
  UNION ALL SELECT t, c, load_id, 'range' FROM loads WHERE CASE WHEN c = 'low' THEN least <= 0 ELSE least < 0 END
  UNION ALL SELECT l.t, l.c, l.load_id, 'distribution' FROM loads l JOIN far USING (t, c, source, load_id) WHERE n_values > 0 AND n_far >= 0.5 * n_values
  UNION ALL SELECT l.t, l.c, l.load_id, 'distinct' FROM loads l JOIN oth o USING (t, c, source, load_id)
    WHERE l.n_values > 0 AND o.n_values > 0 AND l.n_distinct / l.n_values < (1 / 3) * (o.n_distinct / o.n_values)
)""",
    "p1_profile": f"""WITH {_VALUES} SELECT t AS table_name, c AS column_name, source, load_id, n_rows, n_null, n_unreadable, n_values, n_distinct, least, most FROM loads""",
    "p1_masks": f"""WITH {_VALUES}, {_MASKS} SELECT t AS table_name, c AS column_name, source, load_id, mask, n, n_mask < 0.005 * n_source AS rare FROM prof""",
    "p1_divergence": f"""WITH {_VALUES}, {_MASKS},
pq AS (SELECT *, n / n_load AS p, CASE WHEN n_source > n_load THEN (n_mask - n) / (n_source - n_load) END AS q0, coalesce(q0, 0) AS q FROM prof)
SELECT t AS table_name, c AS column_name, source, load_id, CAST(sum(n) AS BIGINT) AS n_texts, CAST(sum(CASE WHEN n_mask < 0.005 * n_source THEN n ELSE 0 END) AS BIGINT) AS n_rare,
  round(CASE WHEN count(q0) > 0 THEN sum((p * ln(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2) + (1 - sum(q)) * 0.5 * ln(2) END, 6) AS divergence
FROM pq GROUP BY t, c, source, load_id""",
    "p2_found": f"""WITH {_SPIKE}
SELECT r.row_id, k.field FROM (SELECT DISTINCT source, ticker, trade_date, field FROM cases) k
JOIN stg_prices r ON r.source IS NOT DISTINCT FROM k.source AND r.ticker IS NOT DISTINCT FROM k.ticker AND r.trade_date = k.trade_date
WHERE CASE k.field WHEN 'close' THEN r.close IS NOT NULL WHEN 'high' THEN r.high IS NOT NULL ELSE r.volume IS NOT NULL END""",
    "p2_reasons": f"WITH {_SPIKE} SELECT source, ticker, trade_date, field, reason FROM cases",
    "p3_found": f"""WITH {_DAILY}
SELECT ticker, CAST(day AS VARCHAR) AS trade_date, 'volume' AS measure FROM run WHERE measure = 'volume' AND day - 29 >= f AND s30 > 0 AND 15 * s7 >= 7 * s30
UNION ALL SELECT ticker, CAST(day AS VARCHAR), 'silent' FROM run WHERE measure = 'volume' AND day - 6 >= f AND s7 = 0
UNION ALL SELECT ticker, CAST(day AS VARCHAR), 'log_return' FROM run WHERE measure = 'log_return' AND day - 6 >= f AND s7 <= -150000""",
    "p3_rolling": f"""WITH {_DAILY}, scaled AS (SELECT *, CASE measure WHEN 'volume' THEN 1.0::DOUBLE ELSE 1000000.0::DOUBLE END AS k FROM run)
SELECT ticker, day AS trade_date, measure, s7::DOUBLE / k AS total_7, s30::DOUBLE / k AS total_30, s7::DOUBLE / k / 7 AS mean_7, s30::DOUBLE / k / 30 AS mean_30 FROM scaled""",
    "p4_found": f"WITH {_CHANGES} SELECT table_name, entity, snapshot, record, change FROM ch",
    "p4_changes": f"WITH {_CHANGES} SELECT * FROM ch",
    "p5_found": f"WITH {_VERSIONS} SELECT ticker, sector, CAST(valid_from AS VARCHAR) AS valid_from, coalesce(CAST(valid_to AS VARCHAR), 'open') AS valid_to FROM hist",
    "p5_versions": f"WITH {_VERSIONS} SELECT * FROM hist",
    "p6_found": f"WITH {_GRID} SELECT series_id, CAST(trade_date AS VARCHAR) AS trade_date FROM grd WHERE missing",
    "p6_grid": f"WITH {_GRID} SELECT * FROM grd",
    "p6_weeks": f"""WITH {_WEEKS} SELECT series_id, week, round(value, 6) AS value, coalesce(w, 0) / 7 AS coverage,
  round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY week), 6) AS filled, w IS NULL AS missing FROM wc""",
    "p7_found": f"WITH {_KNOWN} SELECT table_name, row_id, coalesce(CAST(known_date AS VARCHAR), 'none') AS known_date FROM kn WHERE NOT agrees",
    "p7_known": f"WITH {_KNOWN} SELECT * FROM kn",
}
