"""The same results as plans/reference.py in DuckDB's SQL."""

from __future__ import annotations

from pitloom.plans.general_sql import _VERSIONS

_PANEL = """
panel AS (
  SELECT ticker, trade_date, open, high, low, close, adj_close, volume, sector, is_benchmark FROM fct_prices_daily
  QUALIFY row_number() OVER (PARTITION BY ticker, trade_date ORDER BY loaded_at DESC, open DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, close DESC NULLS LAST) = 1
),
ret AS (SELECT *, ln(adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY trade_date)) AS r FROM panel),
lab AS (
  SELECT *, lead(trade_date) OVER w AS next_trade_date, lead(close) OVER w AS next_close, lead(adj_close) OVER w AS next_adj_close, lead(r) OVER w AS nr
  FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
)"""

_MACRO = """
sp AS (SELECT series_id, min(vintage_date) AS a, max(vintage_date) AS b FROM stg_macro_series GROUP BY ALL),
dd AS (SELECT * FROM (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM sp) WHERE isodow(trade_date) < 6),
vt AS (SELECT DISTINCT series_id, vintage_date FROM stg_macro_series),
dv AS (SELECT dd.series_id, trade_date, vintage_date FROM dd ASOF JOIN vt ON dd.series_id = vt.series_id AND dd.trade_date >= vt.vintage_date),
ob AS (SELECT DISTINCT series_id, vintage_date, observation_date, value FROM stg_macro_series),
md AS (
  SELECT dv.trade_date, dv.series_id, dv.vintage_date, ob.observation_date, ob.value
  FROM dv ASOF JOIN ob ON dv.series_id = ob.series_id AND dv.vintage_date = ob.vintage_date AND dv.trade_date >= ob.observation_date
)"""

_SERIES = ["PORTCALLS000000", "HOUSESTART000001", "CREDITGAP000002", "MILLOUT000003", "TRUCKORD000004", "RATEPATH000005", "MILLOUT000006", "CORECPI000007", "POTOUT000000"]
_WIDE = "wide AS (SELECT trade_date, " + ", ".join(f"max(value) FILTER (series_id = '{k}') AS macro_{k.lower()}" for k in _SERIES) + " FROM md WHERE series_id IN ('" + "', '".join(_SERIES) + "') GROUP BY trade_date)"
_YOY = """yoy AS (
  SELECT trade_date, macro_ratepath000005, macro_creditgap000002, macro_portcalls000000, macro_millout000003,
         (macro_corecpi000007 / nullif(lag(macro_corecpi000007, 252) OVER w, 0) - 1) * 100 AS macro_corecpi000007_yoy,
         (macro_housestart000001 / nullif(lag(macro_housestart000001, 252) OVER w, 0) - 1) * 100 AS macro_housestart000001_yoy
  FROM wide WINDOW w AS (ORDER BY trade_date)
)"""
_MC = "macro_ratepath000005, macro_creditgap000002, macro_portcalls000000, macro_millout000003, round(macro_corecpi000007_yoy, 6) AS macro_corecpi000007_yoy, round(macro_housestart000001_yoy, 6) AS macro_housestart000001_yoy"

_FILED = """
fl AS (
  SELECT ticker, namespace, tag, filed, value, period_end FROM stg_sec_facts WHERE form IN ('10-K', '10-Q') AND value IS NOT NULL AND period_end <= filed
  QUALIFY row_number() OVER (PARTITION BY ticker, namespace, tag, filed ORDER BY period_end DESC, coalesce(period_end - period_start, -1) DESC, value DESC) = 1
)"""
_TAGS = ["OwnersFunds", "PlantOutlay", "ProfitAfterTax", "SalesNet", "StaffCount"]
_FACTS = f"""{_FILED},
keys AS (SELECT ticker, trade_date, 'xg-core' AS namespace, unnest({_TAGS}) AS tag FROM panel),
fd AS (
  SELECT k.trade_date, k.ticker, k.namespace, k.tag, fl.value, fl.filed AS filed_used, fl.period_end AS period_end_used
  FROM keys k ASOF LEFT JOIN fl ON k.ticker = fl.ticker AND k.namespace = fl.namespace AND k.tag = fl.tag AND k.trade_date >= fl.filed
),
fw AS (SELECT ticker, trade_date, {", ".join(f"max(value) FILTER (tag = '{t}') AS {t.lower()}" for t in _TAGS)} FROM fd WHERE value IS NOT NULL GROUP BY ALL),
fr AS (
  SELECT ticker, trade_date, profitaftertax / nullif(salesnet, 0) AS fd_margin, profitaftertax / nullif(ownersfunds, 0) AS fd_roe, plantoutlay / nullif(salesnet, 0) AS fd_outlay,
         salesnet / nullif(staffcount, 0) AS fd_sales_per_head,
         CASE WHEN p IS NULL OR salesnet IS NULL THEN NULL WHEN p = 0 THEN CASE WHEN salesnet > 0 THEN 5.0 WHEN salesnet < 0 THEN -1.0 END ELSE least(5.0, greatest(-1.0, salesnet / p - 1)) END AS fd_growth
  FROM (SELECT *, lag(salesnet, 120) OVER (PARTITION BY ticker ORDER BY trade_date) AS p FROM fw)
)"""

_PX = """
px0 AS (
  SELECT *, row_number() OVER w - 2 AS k, adj_close - lag(adj_close) OVER w AS d, ln(adj_close / lag(adj_close, 5) OVER w) AS r5, ln(adj_close / lag(adj_close, 20) OVER w) AS r20,
         adj_close / lag(adj_close, 60) OVER w - 1 AS mom
  FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
),
px AS (
  SELECT *,
         CASE WHEN count(r) OVER w5 = 5 THEN stddev_samp(r) OVER w5 * sqrt(252) END AS v5, CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END AS v20,
         CASE WHEN count(r) OVER w60 = 60 THEN stddev_samp(r) OVER w60 * sqrt(252) END AS v60, count(d) OVER u AS nd,
         sum(greatest(d, 0) * CASE WHEN k = 0 THEN 1.0 ELSE pow(14 / 13.0, k) / 14 END) OVER u AS gain, sum(greatest(-d, 0) * CASE WHEN k = 0 THEN 1.0 ELSE pow(14 / 13.0, k) / 14 END) OVER u AS loss
  FROM px0 WINDOW w5 AS (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING),
    w60 AS (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING), u AS (PARTITION BY ticker ORDER BY trade_date ROWS UNBOUNDED PRECEDING)
),
pf AS (
  SELECT *, v5 / nullif(v20, 0) AS vr, CASE WHEN nd >= 14 THEN CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100.0 END ELSE 100 - 100 / (1 + gain / loss) END END AS rsi FROM px
)"""
_PXCOLS = """round(r, 6) AS px_ret_1d, round(r5, 6) AS px_ret_5d, round(r20, 6) AS px_ret_20d, round(v5, 6) AS px_vol_5d, round(v20, 6) AS px_vol_20d, round(v60, 6) AS px_vol_60d,
  round(vr, 6) AS px_vol_ratio, round(mom, 6) AS px_mom_60d"""
_MKT = """
mk AS (SELECT trade_date, max(r) AS m FROM ret WHERE is_benchmark GROUP BY trade_date),
mj AS (SELECT ticker, ret.trade_date, r, CASE WHEN r IS NOT NULL THEN m END AS m, CASE WHEN m IS NOT NULL THEN r END AS x FROM ret LEFT JOIN mk USING (trade_date)),
mf AS (
  SELECT ticker, trade_date, CASE WHEN count(x) OVER w = 60 THEN covar_samp(x, m) OVER w / nullif(var_samp(m) OVER w, 0) END AS beta,
         CASE WHEN count(x) OVER w = 60 THEN least(1.0, greatest(-1.0, covar_samp(x, m) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(m) OVER w, 0))) END AS corr
  FROM mj WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING)
)"""
_CS = """
cv AS (SELECT ticker, trade_date, sector, is_benchmark, round(ln(adj_close / lag(adj_close, 20) OVER (PARTITION BY ticker ORDER BY trade_date)), 6) AS v FROM panel),
cs AS (
  SELECT *,
    CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, v) - 1) / 2) / count(v) OVER (PARTITION BY trade_date) END AS cs_market_rank_20d,
    CASE WHEN v IS NOT NULL AND sector IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, sector ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, sector, v) - 1) / 2) / count(v) OVER (PARTITION BY trade_date, sector) END AS cs_sector_rank_20d
  FROM cv
)"""
_ALL = f"""{_PANEL}, {_PX}, {_MKT}, {_CS}, {_MACRO}, {_WIDE}, {_YOY}, {_FACTS},
feat AS (
  SELECT pf.ticker, pf.trade_date, pf.sector, pf.is_benchmark, nr > 0 AS next_return_positive, round(nr, 6) AS next_log_return, {_PXCOLS}, round(beta, 6) AS mkt_beta_60d, round(corr, 6) AS mkt_corr_60d, {_MC},
    round(fd_margin, 6) AS fd_margin, round(fd_roe, 6) AS fd_roe, round(fd_outlay, 6) AS fd_outlay, round(fd_sales_per_head, 6) AS fd_sales_per_head, round(fd_growth, 6) AS fd_growth, round(rsi, 4) AS px_rsi_14,
    cs_market_rank_20d, cs_sector_rank_20d
  FROM pf JOIN (SELECT ticker, trade_date, nr FROM lab) l USING (ticker, trade_date) LEFT JOIN mf USING (ticker, trade_date) LEFT JOIN yoy USING (trade_date) LEFT JOIN fr USING (ticker, trade_date)
    JOIN (SELECT ticker, trade_date, cs_market_rank_20d, cs_sector_rank_20d FROM cs) c USING (ticker, trade_date)
)"""

_PRED = """
pr AS (
  SELECT ticker, trade_date, sector, close, round(1 / (1 + exp(-ln(adj_close / lag(adj_close, 20) OVER w) * 5)), 6) AS prob, CAST(nr > 0 AS INT) AS y, round(exp(nr) - 1, 6) AS next_return
  FROM lab WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
)"""
_TOP = """
tp AS (SELECT *, CASE WHEN prob IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date ORDER BY prob DESC NULLS LAST, ticker) <= 10 ELSE FALSE END AS selected FROM pr),
wt AS (SELECT *, CASE WHEN selected THEN least(1.0 / count(*) FILTER (selected) OVER (PARTITION BY trade_date), 0.05) ELSE 0.0 END AS weight FROM tp)"""

_CLASS = """
AS (
  SELECT {k}, count(*) AS n, sum(y) AS n1, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, prob))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob))))) AS ll,
         avg((prob - y) * (prob - y)) AS brier, avg(CASE WHEN (prob > 0.5) = (y > 0.5) THEN 1.0 ELSE 0.0 END) AS hit, sum(CASE WHEN y = 1 THEN rk END) AS sr
  FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY prob) + (count(*) OVER (PARTITION BY {k}, prob) - 1) / 2 AS rk FROM {t})
  GROUP BY {k}
)"""

_TRADE = """
AS (
  SELECT {k}, count(*) AS n, avg(next_return) AS m, stddev_samp(next_return) AS s, arg_max(v, trade_date) AS v, max(1 - v / greatest(1.0, p)) AS dd
  FROM (SELECT *, max(v) OVER (PARTITION BY {k} ORDER BY trade_date) AS p
        FROM (SELECT *, product(1 + next_return) OVER (PARTITION BY {k} ORDER BY trade_date) AS v FROM {t}))
  GROUP BY {k}
)"""



def _dense(src: str, value: str) -> str:
    """Per portfolio g and date number i: the date, the names ever held and a list of their targets and of ``value``."""
    return f"""
nm AS (SELECT DISTINCT g, ticker FROM {src} WHERE weight <> 0),
dy AS (SELECT g, trade_date, row_number() OVER (PARTITION BY g ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, trade_date FROM {src} JOIN nm USING (g, ticker))),
ar AS (
  SELECT dy.g, dy.trade_date, dy.i, dy.n, list(nm.ticker ORDER BY nm.ticker) AS names, list(coalesce(weight, 0.0) ORDER BY nm.ticker) AS t, list({value} ORDER BY nm.ticker) AS p
  FROM dy JOIN nm ON dy.g = nm.g LEFT JOIN {src} s ON s.g = dy.g AND s.trade_date = dy.trade_date AND s.ticker = nm.ticker GROUP BY ALL
)"""


def _limits(src: str) -> str:
    """lw: (g, trade_date, ticker, target, weight, stop_out, state) of ``src`` (g, trade_date, ticker, weight, price), date by date."""
    ks = "range(1, len(names) + 1)"
    return _dense(src, "price").replace("nm AS", "ln AS").replace(" nm ", " ln ").replace("nm.", "ln.").replace("dy AS", "ld AS").replace("FROM dy", "FROM ld").replace("dy.", "ld.").replace("ar AS", "la AS") + f""",
lm AS (SELECT *, lag(p) OVER (PARTITION BY g ORDER BY i) AS q FROM la),
lr AS (SELECT *, list_transform({ks}, lambda k: CASE WHEN q[k] <> 0 THEN coalesce(p[k] / q[k] - 1, 0.0) ELSE 0.0 END) AS mv FROM lm),
lk(g, i, trade_date, names, t, value, peak, halted, o, entry, blocked, stops, state) AS (
  SELECT g, CAST(-1 AS BIGINT), trade_date, names, t, 1.0::DOUBLE, 1.0::DOUBLE, FALSE, list_transform({ks}, lambda k: 0.0::DOUBLE), list_transform({ks}, lambda k: NULL::DOUBLE), list_transform({ks}, lambda k: -1::BIGINT), list_transform({ks}, lambda k: FALSE), ''
  FROM lr WHERE i = 0
  UNION ALL
  SELECT g, i, trade_date, names, t, value, peak, halt,
    list_transform({ks}, lambda k: CASE WHEN NOT halt AND go[k] AND NOT st[k] THEN t[k] * f ELSE 0.0 END),
    CASE WHEN halt THEN entry ELSE list_transform({ks}, lambda k: CASE WHEN fr[k] AND NOT (go[k] AND NOT st[k]) THEN NULL WHEN go[k] AND entry[k] IS NULL THEN p[k] ELSE entry[k] END) END,
    CASE WHEN halt THEN blocked ELSE list_transform({ks}, lambda k: CASE WHEN st[k] THEN least(i + 5, n - 1) ELSE blocked[k] END) END,
    list_transform({ks}, lambda k: NOT halt AND st[k]), CASE WHEN halt THEN 'halt' WHEN f < 1 THEN 'derisk' ELSE 'normal' END
  FROM (
    SELECT *, list_transform({ks}, lambda k: coalesce(go[k] AND entry[k] IS NOT NULL AND p[k] / entry[k] - 1 <= -0.08, FALSE)) AS st
    FROM (
      SELECT *, list_transform({ks}, lambda k: coalesce(fr[k] AND t[k] * f <> 0 AND p[k] > 0, FALSE)) AS go
      FROM (
        SELECT *, halted OR loss <= -0.20 AS halt, CASE WHEN loss <= -0.10 THEN 0.5 ELSE 1.0 END AS f, list_transform({ks}, lambda k: i > blocked[k]) AS fr
        FROM (
          SELECT *, value / greatest(peak0, value) - 1 AS loss, greatest(peak0, value) AS peak
          FROM (
            SELECT lr.g, lr.i, lr.n, lr.trade_date, lr.names, lr.t, lr.p, lk.halted, lk.entry, lk.blocked, lk.peak AS peak0,
              CASE WHEN lk.halted THEN lk.value ELSE lk.value * (1 + list_sum(list_transform(range(1, len(lr.names) + 1), lambda k: lk.o[k] * lr.mv[k]))) END AS value
            FROM lk JOIN lr ON lk.g = lr.g AND lr.i = lk.i + 1
          )
        )
      )
    )
  )
),
lw AS (
  SELECT g, trade_date, u.ticker, u.target, least(0.05, greatest(0.0, u.weight)) AS weight, u.stop_out, state
  FROM (SELECT g, trade_date, state, unnest(list_transform({ks}, lambda k: {{'ticker': names[k], 'target': t[k], 'weight': o[k], 'stop_out': stops[k]}})) AS u FROM lk WHERE i >= 0)
)"""


def _bands(src: str) -> str:
    """bw: (g, trade_date, ticker, weight, traded, next_return) of ``src`` (g, trade_date, ticker, weight, next_return), date by date."""
    ks = "range(1, len(names) + 1)"
    return _dense(src, "next_return") + f""",
bl AS (SELECT *, lag(p) OVER (PARTITION BY g ORDER BY i) AS q FROM ar),
bk(g, i, trade_date, names, p, o, d) AS (
  SELECT g, CAST(-1 AS BIGINT), trade_date, names, p, list_transform({ks}, lambda k: 0.0::DOUBLE), list_transform({ks}, lambda k: 0.0::DOUBLE) FROM bl WHERE i = 0
  UNION ALL
  SELECT g, i, trade_date, names, p, list_transform({ks}, lambda k: CASE WHEN i = 0 OR abs(t[k] - dr[k]) > 0.01 THEN t[k] ELSE dr[k] END), dr
  FROM (
    SELECT *, list_transform({ks}, lambda k: CASE WHEN i > 0 AND whole > -0.999999 THEN o[k] * (1 + coalesce(q[k], 0.0)) / (1 + whole) ELSE 0.0 END) AS dr
    FROM (
      SELECT bl.g, bl.i, bl.trade_date, bl.names, bl.t, bl.p, bl.q, bk.o, list_sum(list_transform(range(1, len(bl.names) + 1), lambda k: bk.o[k] * coalesce(bl.q[k], 0.0))) AS whole
      FROM bk JOIN bl ON bk.g = bl.g AND bl.i = bk.i + 1
    )
  )
),
bw AS (
  SELECT g, trade_date, u.ticker, u.weight, abs(u.weight - u.drifted) AS traded, u.next_return
  FROM (SELECT g, trade_date, unnest(list_transform({ks}, lambda k: {{'ticker': names[k], 'weight': o[k], 'drifted': d[k], 'next_return': p[k]}})) AS u FROM bk WHERE i >= 0)
),
br AS (
  SELECT g, trade_date, sum(weight * coalesce(next_return, 0.0)) AS gross, (1 - sum(weight)) * (pow(1.02, 1 / 252) - 1) AS cash_ret, sum(traded) * 2.5 / 10000 AS cost, sum(traded) AS turnover FROM bw GROUP BY ALL
)"""


_WALKED = "wk AS (SELECT 'momentum' AS g, trade_date, ticker, CAST(weight AS DOUBLE) AS weight, close AS price, next_return FROM wt WHERE prob IS NOT NULL)"
_RETURNS = "round(gross, 8) AS gross, round(cash_ret, 8) AS cash_ret, round(cost, 8) AS cost, round(gross + cash_ret - cost, 8) AS net, round(turnover, 8) AS turnover"

_FOLDS = """
dts AS (SELECT DISTINCT trade_date AS d FROM fct_prices_daily),
walk(ts) AS (
  SELECT CAST(min(d) + INTERVAL 3 MONTH AS DATE) FROM dts
  UNION ALL
  SELECT (SELECT min(d) FROM dts WHERE d >= ts + INTERVAL 1 MONTH) FROM walk WHERE (SELECT min(d) FROM dts WHERE d >= ts + INTERVAL 1 MONTH) IS NOT NULL
),
raw AS (
  SELECT ts AS test_start, (SELECT max(d) FROM dts WHERE d >= ts AND d < ts + INTERVAL 1 MONTH) AS test_end, (SELECT count(*) FROM dts WHERE d >= ts AND d < ts + INTERVAL 1 MONTH) AS n_test,
         (SELECT list(d ORDER BY d) FROM dts WHERE d >= ts - INTERVAL 3 MONTH AND d < ts) AS c FROM walk
),
cut AS (SELECT *, len(c) - 6 AS n_train FROM raw),
fold AS (
  SELECT CAST(row_number() OVER (ORDER BY test_start) - 1 AS INT) AS fold_id, c[1] AS train_start, c[n_train] AS train_end, test_start, test_end, CAST(n_train AS INT) AS n_train, CAST(n_test AS INT) AS n_test
  FROM cut WHERE n_train >= 30 AND n_test >= 10
)"""

_TWO = f"""{_FOLDS}, {_PANEL}, {_PRED},
mp AS (
  SELECT model || '|' || fold_id AS g, model, fold_id, ticker, trade_date, close AS price, next_return, y, CASE model WHEN 'momentum' THEN prob ELSE round(1 - prob, 6) END AS prob
  FROM pr JOIN fold ON trade_date BETWEEN test_start AND test_end CROSS JOIN (SELECT unnest(['momentum', 'reversal']) AS model) WHERE prob IS NOT NULL
),
mt AS (SELECT *, row_number() OVER (PARTITION BY g, trade_date ORDER BY prob DESC, ticker) <= 10 AS selected FROM mp),
mw AS (SELECT *, CASE WHEN selected THEN CAST(least(1.0 / count(*) FILTER (selected) OVER (PARTITION BY g, trade_date), 0.05) AS DOUBLE) ELSE 0.0 END AS weight FROM mt),
{_limits("mw")},
mb AS (SELECT lw.g, lw.trade_date, lw.ticker, lw.weight, mp.next_return FROM lw LEFT JOIN mp USING (g, trade_date, ticker)),
{_bands("mb")},
mr AS (SELECT split_part(g, '|', 1) AS model, CAST(split_part(g, '|', 2) AS INT) AS fold_id, trade_date, gross, cash_ret, cost, gross + cash_ret - cost AS next_return, turnover FROM br),
kp AS (SELECT * FROM mp WHERE y IS NOT NULL), cf {_CLASS.format(k="model, fold_id", t="kp")}, tf {_TRADE.format(k="model, fold_id", t="mr")},
pf AS (
  SELECT model, fold_id, cf.n AS n_obs, tf.n AS n_days, CASE WHEN n1 BETWEEN 1 AND cf.n - 1 THEN ll END AS log_loss, brier, hit AS hit_rate, CASE WHEN n1 BETWEEN 1 AND cf.n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (cf.n - n1)) END AS auc,
    CASE WHEN s >= 1e-12 THEN m / s * sqrt(252) ELSE 0 END AS sharpe, v - 1 AS total_return, dd AS max_drawdown
  FROM cf FULL JOIN tf USING (model, fold_id)
),
jn AS (SELECT * FROM mr QUALIFY row_number() OVER (PARTITION BY model, trade_date ORDER BY fold_id) = 1)"""
_SCORES = "round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(hit_rate, 6) AS hit_rate, round(auc, 6) AS auc, round(sharpe, 4) AS sharpe, round(total_return, 4) AS total_return, round(max_drawdown, 4) AS max_drawdown"


def _cdf(x: str) -> str:
    """Share of the normal distribution below x."""
    series = f"list_sum(list_transform(range(0, 160), lambda k: exp(k * ln(greatest({x} * {x}, 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + {x} * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END"


_QUANTILE = f"z - greatest(-1.0, least(1.0, ({_cdf('z')} - p) / (exp(-z * z / 2) / sqrt(2 * pi()))))"

_DRIFT = """
dx AS (SELECT trade_date, round(r, 6) AS px_ret, volume, close FROM ret),
dk AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date AS d FROM dx)),
dp AS (SELECT d, CASE WHEN k <= 30 THEN 'ref' WHEN k > n - 30 THEN 'cur' END AS part FROM dk WHERE n >= 60),
dl AS (
  SELECT part, feature, x FROM (
    SELECT part, 'px_ret' AS feature, px_ret AS x FROM dx JOIN dp ON trade_date = d UNION ALL SELECT part, 'volume', CAST(volume AS DOUBLE) FROM dx JOIN dp ON trade_date = d
    UNION ALL SELECT part, 'close', close FROM dx JOIN dp ON trade_date = d) WHERE part IS NOT NULL AND x IS NOT NULL
),
dn AS (SELECT feature, count(*) FILTER (part = 'ref') AS n_ref, count(*) FILTER (part = 'cur') AS n_cur FROM dl GROUP BY ALL)"""

_PERF = f"""{_PANEL}, {_PRED}, mo AS (SELECT *, CAST(date_trunc('month', trade_date) AS DATE) AS month FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL), cl {_CLASS.format(k="sector, month", t="mo")},
pm AS (
  SELECT sector, month, unnest([{{'metric': 'log_loss', 'x': round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN ll END, 6)}}, {{'metric': 'brier', 'x': round(brier, 6)}},
    {{'metric': 'auc', 'x': round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6)}}]) AS c FROM cl
),
pk AS (SELECT sector, c.metric AS metric, c.x AS x, CASE WHEN c.x IS NOT NULL THEN row_number() OVER (PARTITION BY sector, c.metric, c.x IS NULL ORDER BY month DESC) END AS k FROM pm),
pa AS (SELECT sector, metric, avg(x) FILTER (k <= 4) AS mean FROM pk GROUP BY ALL),
ps AS (
  SELECT sector, metric, round(mean, 5) AS mean, CASE metric
    WHEN 'log_loss' THEN CASE WHEN mean >= 0.75 THEN 'FAIL' WHEN mean >= 0.72 THEN 'WARN' ELSE 'PASS' END
    WHEN 'brier' THEN CASE WHEN mean >= 0.28 THEN 'FAIL' WHEN mean >= 0.26 THEN 'WARN' ELSE 'PASS' END
    ELSE CASE WHEN mean <= 0.48 THEN 'FAIL' WHEN mean <= 0.50 THEN 'WARN' ELSE 'PASS' END END AS status FROM pa
)"""

_PXS = ["px_ret_1d", "px_ret_5d", "px_ret_20d", "px_vol_5d", "px_vol_20d", "px_vol_60d", "px_vol_ratio", "px_mom_60d", "px_rsi_14", "mkt_beta_60d", "mkt_corr_60d", "cs_market_rank_20d", "cs_sector_rank_20d", "fd_margin", "fd_roe", "fd_outlay", "fd_sales_per_head", "fd_growth"]
_STATUS = f"""{_ALL},
wd AS (SELECT d, CASE WHEN k <= 60 THEN 'ref' WHEN k > n - 60 THEN 'cur' END AS part FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date AS d FROM panel)) WHERE n >= 120),
fx AS (
  SELECT feat.* REPLACE (round(pf.rsi, 6) AS px_rsi_14, round(cs_market_rank_20d, 6) AS cs_market_rank_20d, round(cs_sector_rank_20d, 6) AS cs_sector_rank_20d), pf.close, CAST(pf.volume AS DOUBLE) AS volume, part
  FROM feat JOIN pf USING (ticker, trade_date) JOIN wd ON feat.trade_date = wd.d WHERE part IS NOT NULL
),
ms AS (SELECT dd.series_id, dd.trade_date, value FROM dd LEFT JOIN md USING (series_id, trade_date)),
my AS (SELECT *, (value / nullif(lag(value, 252) OVER (PARTITION BY series_id ORDER BY trade_date), 0) - 1) * 100 AS yoy FROM ms),
dl AS (
  SELECT part, c.f AS feature, c.x AS x FROM (
    SELECT part, unnest([{", ".join(f"{{'f': '{c}', 'x': {c}}}" for c in ["close", "volume", *_PXS])}]) AS c FROM fx
    UNION ALL SELECT part, unnest([{{'f': 'macro:' || series_id, 'x': value}}, {{'f': 'macro_yoy:' || series_id, 'x': round(yoy, 6)}}]) FROM my JOIN wd ON trade_date = wd.d WHERE part IS NOT NULL
  ) WHERE c.x IS NOT NULL AND isfinite(c.x)
),
dn AS (SELECT feature, count(*) FILTER (part = 'ref') AS n_ref, count(*) FILTER (part = 'cur') AS n_cur FROM dl GROUP BY ALL),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM dl WHERE part = 'ref' GROUP BY feature),
bn AS (SELECT feature, part, len(list_filter(e[2:len(e) - 1], lambda b: b <= x)) AS bin FROM dl JOIN ed USING (feature) WHERE len(e) >= 3),
sh AS (SELECT feature, bin, greatest(1e-6, count(*) FILTER (part = 'ref') / any_value(n_ref)) AS r, greatest(1e-6, count(*) FILTER (part = 'cur') / any_value(n_cur)) AS c FROM bn JOIN dn USING (feature) WHERE n_ref >= 2 AND n_cur >= 2 GROUP BY ALL),
ps AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY feature),
cu AS (SELECT feature, x, sum(CAST(part = 'ref' AS INT)) OVER w / n_ref AS a, sum(CAST(part = 'cur' AS INT)) OVER w / n_cur AS b FROM dl JOIN dn USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY x RANGE UNBOUNDED PRECEDING)),
kd AS (SELECT feature, n_ref, n_cur, psi, CASE WHEN n_ref >= 2 AND n_cur >= 2 THEN d END AS d, sqrt(n_ref * n_cur / (n_ref + n_cur)) AS en FROM dn LEFT JOIN (SELECT feature, max(abs(a - b)) AS d FROM cu GROUP BY feature) USING (feature) LEFT JOIN ps USING (feature)),
kp AS (SELECT *, (en + 0.12 + 0.11 / en) * d AS lam FROM kd),
kv AS (
  SELECT *, CASE WHEN d IS NULL THEN NULL WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * lam * lam))))) END AS p FROM kp
),
st AS (
  SELECT feature, n_ref, n_cur, round(psi, 6) AS psi, round(d, 6) AS ks_stat, round(p, 6) AS ks_pvalue,
    CASE greatest(CASE WHEN psi >= 0.25 THEN 2 WHEN psi >= 0.10 THEN 1 ELSE 0 END, CASE WHEN p <= 0.01 THEN 2 WHEN p <= 0.05 THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM kv
)"""


def _bad(table: str, rules: dict[str, str], keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS rule FROM {table} WHERE NOT coalesce({r}, TRUE)" for n, r in rules.items())


_OHLC = {
    "positive": "least(open, high, low, close) > 0",
    "high": "high >= greatest(open, close, low)",
    "low": "low <= least(open, close, high)",
    "volume": "volume >= 0",
}


def _contract(table: str, rules: dict[str, str], columns: list[str], unique: str | None) -> str:
    parts = [f"SELECT '{table}' AS contract, 'not_empty' AS rule, CAST(count(*) = 0 AS BIGINT) AS violations FROM {table}"]
    parts += [f"SELECT '{table}', '{n}', count(*) FILTER (NOT coalesce({r}, TRUE)) FROM {table}" for n, r in rules.items()]
    parts += [f"SELECT '{table}', 'column:{c}', CAST(0 AS BIGINT)" for c in columns]
    if unique:
        parts.append(f"SELECT '{table}', 'unique', count(*) FROM (SELECT 1 FROM {table} GROUP BY {unique} HAVING count(*) > 1)")
    return " UNION ALL ".join(parts)


def _nn(*names: str) -> dict[str, str]:
    return {f"not_null:{c}": f"{c} IS NOT NULL" for c in names}


def _later(a: str, b: str) -> dict[str, str]:
    return {f"not_later:{a}": f"{a} <= {b}"}


_DAMAGED = """
dm AS (
  SELECT ticker, trade_date, nr, CASE WHEN day(trade_date) <> 15 THEN r END AS r, CASE day(trade_date) WHEN 13 THEN NULL WHEN 17 THEN NOT (nr > 0) ELSE nr > 0 END AS label FROM lab
)"""
_COLUMNS = {
    "stg_prices": "row_id source ticker trade_date open high low close adj_close volume load_id loaded_at",
    "fct_prices_daily": "ticker trade_date open high low close adj_close volume sector is_benchmark loaded_at",
    "fct_returns_daily": "ticker trade_date close adj_close volume log_return next_trade_date next_close next_adj_close next_log_return next_return_positive sector is_benchmark loaded_at",
    "stg_macro_series": "series_id observation_date vintage_date value",
    "int_macro_daily": "row_id trade_date series_id vintage_date observation_date value",
    "stg_sec_facts": "ticker cik namespace tag unit period_start period_end filed form fiscal_year fiscal_period frame value",
    "int_fundamentals_pit": "row_id trade_date ticker namespace tag value filed_used period_end_used",
    "ticker_metadata": "snapshot_date delivered_at ticker sector is_benchmark valid_from valid_to",
    "manifest": "manifest_no source ticker latest_hash path written_at row_count first_date last_date",
    "drift_features": "report_id source generated_at feature status psi ks_pvalue n_ref n_cur reason",
}
_LIKE = {"matches:ticker": "regexp_full_match(ticker, '[A-Z][A-Z0-9]{0,9}')"}
_RULES = {
    "stg_prices": (_nn("open", "low", "adj_close", "volume", "close") | _OHLC | _LIKE, "source, ticker, trade_date"),
    "fct_prices_daily": (_nn("ticker", "trade_date", "close", "volume") | _OHLC, "ticker, trade_date"),
    "fct_returns_daily": (_nn("ticker", "trade_date", "sector") | {f"between:{c}": f"{c} BETWEEN -1 AND 1" for c in ("log_return", "next_log_return")} | _later("trade_date", "next_trade_date"), "ticker, trade_date"),
    "stg_macro_series": (_nn("series_id", "value"), "series_id, observation_date, vintage_date"),
    "int_macro_daily": (_nn("series_id", "trade_date", "vintage_date") | _later("vintage_date", "trade_date") | _later("observation_date", "trade_date"), "trade_date, series_id"),
    "stg_sec_facts": (
        _nn("ticker", "tag", "period_end", "filed", "form", "value") | {"between:fiscal_year": "fiscal_year BETWEEN 1990 AND 2100", "length:form": "length(form) <= 16"} | _later("period_start", "period_end") | _later("period_end", "filed"), None,
    ),
    "int_fundamentals_pit": (_nn("ticker", "trade_date", "tag") | _later("filed_used", "trade_date") | _later("period_end_used", "filed_used"), "trade_date, ticker, namespace, tag"),
    "ticker_metadata": (_nn("ticker", "sector", "valid_from") | _later("valid_from", "valid_to") | _LIKE, "ticker, snapshot_date"),
    "manifest": (_nn("source", "ticker", "latest_hash", "path") | _later("first_date", "last_date") | {"positive:row_count": "row_count > 0"}, "source, manifest_no, ticker"),
    "drift_features": (_nn("status", "psi") | {"accepted:status": "status IN ('PASS', 'WARN', 'FAIL')"}, None),
}
_CONTRACTS = " UNION ALL ".join(
    _contract(t, rules, _COLUMNS[t].split(), unique) + f" UNION ALL SELECT '{t}', 'other_columns', count(*) FILTER (column_name NOT IN ('" + "', '".join(_COLUMNS[t].split()) + f"')) FROM (DESCRIBE {t})" for t, (rules, unique) in _RULES.items()
)
_BARS = {"missing": " AND ".join(f"{c} IS NOT NULL" for c in ("open", "high", "low", "close", "adj_close", "volume"))} | {f"positive:{c}": f"{c} > 0" for c in ("open", "high", "low", "close", "adj_close")}
_BARS |= {f"{a}>{b}": f"{a} <= {b}" for a, b in (("low", "open"), ("low", "close"), ("open", "high"), ("close", "high"))} | {"volume": "volume >= 0"}


def _framed(*parts: str) -> str:
    return " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE length({x}) || ':' || {x} END" for x in parts)


_FLAT = """SELECT ticker, coalesce(namespace, 'none') AS namespace, coalesce(tag, 'none') AS tag, coalesce(unit, 'none') AS unit, period_start, period_end, filed, left(form, 16) AS form, fiscal_year,
  nullif(trim(fiscal_period), '') AS fiscal_period, nullif(trim(frame), '') AS frame, value FROM stg_sec_facts WHERE period_end IS NOT NULL AND filed IS NOT NULL AND form IS NOT NULL"""

SQL = {
    "bars_in_force": f"WITH {_PANEL} SELECT * FROM panel",
    "returns_labels": f"""WITH {_PANEL} SELECT ticker, trade_date, round(r, 6) AS log_return, next_trade_date, next_close, next_adj_close, round(nr, 6) AS next_log_return, nr > 0 AS next_return_positive FROM lab""",
    "returns_interval_join": f"""WITH {_PANEL}, {_VERSIONS} SELECT l.ticker, trade_date, close, round(r, 6) AS log_return, h.sector, h.is_benchmark
FROM lab l JOIN hist h ON l.ticker = h.ticker AND trade_date >= h.valid_from AND trade_date <= coalesce(h.valid_to, DATE '9999-12-31')""",
    "macro_vintage_override": """SELECT series_id, CASE WHEN series_id LIKE 'RATEPATH%' THEN observation_date ELSE vintage_date END AS vintage_date, count(*) AS n FROM stg_macro_series GROUP BY ALL""",
    "macro_vintages_latest": """SELECT series_id, vintage_date, max(observation_date) AS max_observation_date, max_by(value, observation_date) AS value FROM stg_macro_series GROUP BY ALL""",
    "macro_asof_daily": f"WITH {_MACRO} SELECT * FROM md",
    "macro_pivot_wide": f"WITH {_MACRO}, {_WIDE} SELECT * FROM wide",
    "mc_yoy": f"WITH {_MACRO}, {_WIDE}, {_YOY} SELECT trade_date, {_MC} FROM yoy",
    "mc_yoy_by_series": f"""WITH {_MACRO}, al AS (SELECT dd.series_id, dd.trade_date, value FROM dd LEFT JOIN md USING (series_id, trade_date))
SELECT series_id, trade_date, value, round((value / nullif(lag(value, 252) OVER (PARTITION BY series_id ORDER BY trade_date), 0) - 1) * 100, 6) AS value_yoy FROM al""",
    "vintage_reconstruct": """WITH s AS (SELECT DISTINCT * FROM stg_macro_series),
i AS (SELECT series_id, observation_date, vintage_date AS b, coalesce(lead(vintage_date) OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date) - 1, DATE '9999-12-31') AS e, value FROM s),
v AS (SELECT DISTINCT series_id, vintage_date FROM s)
SELECT v.series_id, observation_date, vintage_date, value FROM v JOIN i ON v.series_id = i.series_id AND vintage_date BETWEEN b AND e""",
    "macro_latest_mode": """WITH l AS (SELECT series_id, observation_date, value FROM (SELECT DISTINCT * FROM stg_macro_series) QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC) = 1)
SELECT *, max(observation_date) OVER (PARTITION BY series_id) AS vintage_date FROM l""",
    "facts_filter_curated": """SELECT ticker, tag, filed, period_end, value FROM stg_sec_facts
WHERE namespace = 'xg-core' AND tag IN ('SalesNet', 'ProfitAfterTax', 'OwnersFunds') AND form IN ('10-K', '10-Q') AND period_end <= filed AND value IS NOT NULL""",
    "facts_latest_in_filing": f"WITH {_FILED} SELECT * FROM fl",
    "facts_pit_asof": f"WITH {_PANEL}, {_FACTS} SELECT * FROM fd",
    "facts_pivot_first": f"WITH {_PANEL}, {_FACTS} SELECT * FROM fw",
    "fd_ratios": f"WITH {_PANEL}, {_FACTS} SELECT ticker, trade_date, fd_margin, fd_roe, fd_outlay, fd_sales_per_head FROM fr",
    "fd_growth": f"WITH {_PANEL}, {_FACTS} SELECT ticker, trade_date, round(fd_growth, 6) AS fd_growth FROM fr",
    "px_features": f"WITH {_PANEL}, {_PX} SELECT ticker, trade_date, {_PXCOLS}, round(rsi, 4) AS px_rsi_14 FROM pf",
    "cs_ranks": f"WITH {_PANEL}, {_CS} SELECT ticker, trade_date, cs_market_rank_20d, cs_sector_rank_20d FROM cs",
    "mkt_features": f"WITH {_PANEL}, {_MKT} SELECT ticker, trade_date, round(beta, 6) AS mkt_beta_60d, round(corr, 6) AS mkt_corr_60d FROM mf",
    "features_assembled": f"WITH {_ALL} SELECT * FROM feat",
    "features_loaded": f"WITH {_ALL} SELECT ticker, trade_date, px_ret_1d, px_ret_5d, px_ret_20d, px_vol_5d, px_vol_20d, px_vol_60d, px_vol_ratio, px_mom_60d, cs_market_rank_20d, cs_sector_rank_20d FROM feat WHERE next_return_positive IS NOT NULL",
    "entry_top_n": f"WITH {_PANEL}, {_PRED}, {_TOP} SELECT ticker, trade_date, prob FROM tp WHERE selected",
    "entry_threshold": f"WITH {_PANEL}, {_PRED} SELECT ticker, trade_date, prob FROM pr WHERE prob > 0.55",
    "baseline_naive": f"WITH {_PANEL} SELECT ticker, trade_date, CAST(0.5 AS DOUBLE) AS prob, CAST(0 AS DOUBLE) AS weight FROM panel",
    "baseline_momentum": f"WITH {_PANEL}, {_CS} SELECT ticker, trade_date, CAST(CASE WHEN v > 0 THEN 1.0 ELSE 0.45 END AS DOUBLE) AS prob FROM cs",
    "baseline_hold": f"WITH {_PANEL} SELECT ticker, trade_date, CAST(0.5 AS DOUBLE) AS prob, CAST(1 AS DOUBLE) AS weight FROM panel WHERE is_benchmark",
    "baseline_top_rank": f"""WITH {_PANEL}, {_CS}, tk AS (SELECT ticker, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY cs_market_rank_20d DESC, ticker) AS k FROM cs WHERE cs_market_rank_20d IS NOT NULL AND NOT coalesce(is_benchmark, FALSE))
SELECT ticker, trade_date, CAST(CASE WHEN k <= 10 THEN 1.0 ELSE 0.45 END AS DOUBLE) AS prob FROM cs LEFT JOIN tk USING (ticker, trade_date)""",
    "entry_above_median": f"WITH {_PANEL}, {_PRED} SELECT ticker, trade_date, prob FROM pr QUALIFY prob > quantile_cont(prob, 0.5) OVER (PARTITION BY trade_date)",
    "stake_equal_weight": f"WITH {_PANEL}, {_PRED}, {_TOP} SELECT ticker, trade_date, CAST(weight AS DOUBLE) AS weight FROM wt",
    "stake_odds": f"WITH {_PANEL}, {_PRED}, {_TOP} SELECT ticker, trade_date, round(least(0.05, greatest(0.0, 0.25 * (2 * prob - 1))), 8) AS weight FROM tp WHERE selected",
    "stake_scaled": f"""WITH {_PANEL}, {_PRED}, {_TOP},
vl AS (SELECT ticker, trade_date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING))
SELECT ticker, trade_date, round(CASE WHEN vol > 0 THEN 0.05 * least(1.0, 0.10 / vol) ELSE 0.05 END, 6) AS weight FROM tp JOIN vl USING (ticker, trade_date) WHERE selected""",
    "stake_fixed": f"WITH {_PANEL}, {_PRED} SELECT ticker, trade_date, CASE WHEN prob > 0.55 THEN 'long' ELSE 'flat' END AS side, CAST(CASE WHEN prob > 0.55 THEN 0.02 ELSE 0.0 END AS DOUBLE) AS weight FROM pr",
    "turnover": f"""WITH {_PANEL}, {_PRED}, {_TOP}
SELECT trade_date, round(sum(d), 6) AS turnover FROM (SELECT trade_date, CAST(abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY trade_date), 0)) AS DOUBLE) AS d FROM wt) GROUP BY trade_date""",
    "limits_walk": f"WITH RECURSIVE {_PANEL}, {_PRED}, {_TOP}, {_WALKED}, {_limits('wk')} SELECT g AS model, trade_date, ticker, target, CAST(weight AS DOUBLE) AS weight, stop_out, state FROM lw",
    "rebalance_walk": f"WITH RECURSIVE {_PANEL}, {_PRED}, {_TOP}, {_WALKED}, {_bands('wk')} SELECT g AS model, trade_date, ticker, round(weight, 9) AS weight, round(traded, 9) AS traded FROM bw",
    "portfolio_returns": f"WITH RECURSIVE {_PANEL}, {_PRED}, {_TOP}, {_WALKED}, {_bands('wk')} SELECT g AS model, trade_date, {_RETURNS} FROM br",
    "portfolio_by_fold": f"WITH RECURSIVE {_TWO} SELECT split_part(g, '|', 1) AS model, CAST(split_part(g, '|', 2) AS INT) AS fold_id, trade_date, {_RETURNS} FROM br",
    "run_per_fold": f"WITH RECURSIVE {_TWO} SELECT model, fold_id, n_obs, n_days, {_SCORES} FROM pf",
    "run_aggregate": f"""WITH RECURSIVE {_TWO},
l AS (SELECT model, unnest([{{'metric': 'log_loss', 'x': log_loss}}, {{'metric': 'brier', 'x': brier}}, {{'metric': 'hit_rate', 'x': hit_rate}}, {{'metric': 'auc', 'x': auc}}, {{'metric': 'sharpe', 'x': sharpe}}]) AS c FROM pf),
x AS (SELECT model, c.metric AS metric, c.x AS x FROM l WHERE c.x IS NOT NULL)
SELECT model, metric, count(*) AS n, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS sd, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q1,
  round(quantile_cont(x, 0.75), 4) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM x GROUP BY ALL""",
    "run_pooled": f"""WITH RECURSIVE {_TWO}, cp {_CLASS.format(k="model", t="kp")}, tp {_TRADE.format(k="model", t="jn")}
SELECT model, cp.n AS n_obs, tp.n AS n_days, {_SCORES} FROM (SELECT model, n, CASE WHEN n1 BETWEEN 1 AND n - 1 THEN ll END AS log_loss, brier, hit AS hit_rate, CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END AS auc FROM cp) cp
FULL JOIN (SELECT model, n, CASE WHEN s >= 1e-12 THEN m / s * sqrt(252) ELSE 0 END AS sharpe, v - 1 AS total_return, dd AS max_drawdown FROM tp) tp USING (model)""",
    "run_yearly": f"""WITH RECURSIVE {_TWO}, jy AS (SELECT *, CAST(year(trade_date) AS INT) AS year FROM jn), ty {_TRADE.format(k="model, year", t="jy")}
SELECT model, year, n, round(CASE WHEN s >= 1e-12 THEN m / s * sqrt(252) ELSE 0 END, 4) AS sharpe FROM ty""",
    "run_differences": f"""WITH {_PANEL}, {_PRED}, od AS (SELECT *, CAST(day(trade_date) % 2 AS INT) AS odd FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL), cl {_CLASS.format(k="sector, odd", t="od")},
l AS (SELECT odd, 'cls.' || sector || '.brier' AS metric, round(brier, 6) AS value FROM cl UNION ALL SELECT odd, 'cls.' || sector || '.auc', round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6) FROM cl)
SELECT metric, a.value AS a, b.value AS b, CASE WHEN b.metric IS NULL THEN 'removed' WHEN a.metric IS NULL THEN 'added' ELSE 'changed' END AS change
FROM (SELECT * FROM l WHERE odd = 0) a FULL JOIN (SELECT * FROM l WHERE odd = 1) b USING (metric) WHERE a.metric IS NULL OR b.metric IS NULL OR (a.value IS DISTINCT FROM b.value AND coalesce(abs(a.value - b.value) > 1e-9, TRUE))""",
    "best_sectors": f"""WITH {_PANEL}, {_PRED}, kn AS (SELECT * FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL), cl {_CLASS.format(k="sector", t="kn")}
SELECT sector, round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6) AS auc FROM cl ORDER BY auc DESC NULLS LAST, sector LIMIT 5""",
    "calibration": f"""WITH RECURSIVE {_PANEL}, {_PRED},
d AS (SELECT ln(p / (1 - p)) AS x, y, count(*) AS n FROM (SELECT greatest(1e-6, least(1 - 1e-6, prob)) AS p, y FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL) GROUP BY ALL),
nt(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1)
  FROM (
    SELECT k, a, b, sum(n * (y - m)) AS g0, sum(n * (y - m) * x) AS g1, sum(n * m * (1 - m)) AS h0, sum(n * m * (1 - m) * x) AS h1, sum(n * m * (1 - m) * x * x) AS h2
    FROM (SELECT nt.*, d.*, 1 / (1 + exp(-(a + b * x))) AS m FROM nt CROSS JOIN d) GROUP BY k, a, b
  ) WHERE k < 20
)
SELECT round(b, 6) AS slope, round(a, 6) AS intercept FROM nt WHERE k = 20""",
    "deflated_sharpe": f"""WITH RECURSIVE {_PANEL}, {_PRED}, dm AS (SELECT sector, trade_date, avg(next_return) AS next_return FROM pr WHERE next_return IS NOT NULL AND sector IS NOT NULL GROUP BY ALL), tr {_TRADE.format(k="sector", t="dm")},
z AS (SELECT sector, (next_return - avg(next_return) OVER w) / nullif(stddev_samp(next_return) OVER w, 0) AS z FROM dm WINDOW w AS (PARTITION BY sector)),
zz AS (SELECT sector, avg(pow(z, 3)) AS skew, avg(pow(z, 4)) AS kurt FROM z GROUP BY sector),
tn AS (SELECT greatest(2, count(*)) AS n FROM tr),
qt(k, j, p, z) AS (
  SELECT 0, j, p, 0.0::DOUBLE FROM (SELECT 1 AS j, 1 - 1 / n AS p FROM tn UNION ALL SELECT 2, 1 - 1 / (n * exp(1)) FROM tn)
  UNION ALL SELECT k + 1, j, p, {_QUANTILE} FROM qt WHERE k < 40
),
ch AS (SELECT sum(CASE j WHEN 1 THEN (1 - 0.5772156649015329) * z ELSE 0.5772156649015329 * z END) AS c FROM qt WHERE k = 40),
sc AS (SELECT sector, (r * sqrt(n - 1) - c) / sqrt(1 - skew * r + (kurt - 1) / 4 * r * r) AS x FROM (SELECT sector, n, m / s AS r, skew, kurt, c FROM tr JOIN zz USING (sector) CROSS JOIN ch))
SELECT sector, round({_cdf('x')}, 6) AS deflated FROM sc""",
    "folds": f"WITH RECURSIVE {_FOLDS} SELECT * FROM fold",
    "fold_assignment": f"""WITH RECURSIVE {_FOLDS}, {_PANEL}, sp AS (SELECT fold_id, 'train' AS part, train_start AS a, train_end AS b FROM fold UNION ALL SELECT fold_id, 'test', test_start, test_end FROM fold)
SELECT fold_id, part, count(*) AS n, count(DISTINCT trade_date) AS n_dates FROM panel JOIN sp ON trade_date BETWEEN a AND b GROUP BY ALL""",
    "time_decay_weights": f"""WITH RECURSIVE {_FOLDS}, td AS (SELECT fold_id, d FROM fold JOIN dts ON d BETWEEN train_start AND train_end)
SELECT fold_id, d AS trade_date, round(exp(-ln(2) / 30 * (row_number() OVER (PARTITION BY fold_id ORDER BY d DESC) - 1)), 6) AS weight FROM td""",
    "classification_metrics": f"""WITH {_PANEL}, {_PRED}, kn AS (SELECT * FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL), cl {_CLASS.format(k="sector", t="kn")}
SELECT sector, n, round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN ll END, 6) AS log_loss, round(brier, 6) AS brier, round(hit, 6) AS hit_rate, round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6) AS auc FROM cl""",
    "reliability_curve": f"""WITH {_PANEL}, {_PRED} SELECT CAST(least(9, greatest(0, floor(prob * 10))) AS INT) AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(CAST(y AS DOUBLE)), 6) AS mean_truth
FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL GROUP BY ALL""",
    "sharpe_by_year": f"""WITH {_PANEL}, {_PRED}, yr AS (SELECT *, CAST(year(trade_date) AS INT) AS year FROM pr WHERE next_return IS NOT NULL), tr {_TRADE.format(k="ticker, year", t="yr")}
SELECT ticker, year, n, round(CASE WHEN s >= 1e-12 THEN m / s * sqrt(252) ELSE 0 END, 5) AS sharpe, round(v - 1, 5) AS total_return, round(dd, 5) AS max_drawdown FROM tr WHERE n > 2""",
    "skew_kurt": f"""WITH {_PANEL}, {_PRED}, z AS (SELECT ticker, (next_return - avg(next_return) OVER w) / nullif(stddev_samp(next_return) OVER w, 0) AS z FROM pr WHERE next_return IS NOT NULL WINDOW w AS (PARTITION BY ticker))
SELECT ticker, round(avg(pow(z, 3)), 5) AS skew, round(avg(pow(z, 4)), 5) AS kurt FROM z GROUP BY ticker HAVING count(*) > 3""",
    "summary_median_iqr": f"""WITH {_PANEL}, {_PRED}, yr AS (SELECT *, CAST(year(trade_date) AS INT) AS year FROM pr WHERE next_return IS NOT NULL), tr {_TRADE.format(k="ticker, year", t="yr")},
l AS (SELECT year, 'sharpe' AS metric, round(CASE WHEN s >= 1e-12 THEN m / s * sqrt(252) ELSE 0 END, 5) AS x FROM tr WHERE n > 2 UNION ALL SELECT year, 'max_drawdown', round(dd, 5) FROM tr WHERE n > 2)
SELECT year, metric, count(*) AS n, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS sd, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.25), 4) AS q1,
  round(quantile_cont(x, 0.75), 4) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM l GROUP BY ALL""",
    "freshness": "SELECT mart, latest, CAST(DATE '2022-06-30' - latest AS INT) AS age_days, CASE WHEN latest IS NULL OR DATE '2022-06-30' - latest >= f THEN 'FAIL' WHEN DATE '2022-06-30' - latest >= w THEN 'WARN' ELSE 'PASS' END AS status FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS mart, max({c}) AS latest, {w} AS w, {f} AS f FROM {n}"
        for n, c, w, f in (("fct_prices_daily", "trade_date", 3, 7), ("fct_returns_daily", "trade_date", 3, 7), ("int_macro_daily", "trade_date", 45, 90), ("int_fundamentals_pit", "trade_date", 120, 180), ("stg_macro_series", "vintage_date", 45, 90))
    )
    + ")",
    "psi": f"""WITH {_PANEL}, {_DRIFT},
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM dl WHERE part = 'ref' GROUP BY feature),
bn AS (SELECT feature, part, len(list_filter(e[2:len(e) - 1], lambda b: b <= x)) AS bin FROM dl JOIN ed USING (feature) WHERE len(e) >= 3),
sh AS (SELECT feature, bin, greatest(1e-6, count(*) FILTER (part = 'ref') / any_value(n_ref)) AS r, greatest(1e-6, count(*) FILTER (part = 'cur') / any_value(n_cur)) AS c FROM bn JOIN dn USING (feature) WHERE n_ref >= 2 AND n_cur >= 2 GROUP BY ALL)
SELECT feature, n_ref, n_cur, round(sum((c - r) * ln(c / r)), 6) AS psi FROM dn LEFT JOIN sh USING (feature) GROUP BY ALL""",
    "ks_statistic": f"""WITH {_PANEL}, {_DRIFT},
cu AS (SELECT feature, x, sum(CAST(part = 'ref' AS INT)) OVER w / n_ref AS a, sum(CAST(part = 'cur' AS INT)) OVER w / n_cur AS b FROM dl JOIN dn USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY x RANGE UNBOUNDED PRECEDING))
SELECT feature, n_ref, n_cur, round(max(abs(a - b)), 6) AS ks_stat FROM cu JOIN dn USING (feature) GROUP BY ALL""",
    "drift_status": f"WITH {_STATUS} SELECT * FROM st",
    "drift_worst": f"WITH {_STATUS} SELECT * FROM st ORDER BY CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END DESC, psi DESC NULLS LAST, feature LIMIT 10",
    "perf_tail_mean": f"""WITH {_PANEL}, {_PRED}, mo AS (SELECT *, CAST(date_trunc('month', trade_date) AS DATE) AS month FROM pr WHERE prob IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL), cl {_CLASS.format(k="sector, month", t="mo")},
l AS (
  SELECT sector, month, 'log_loss' AS metric, round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN ll END, 6) AS x FROM cl UNION ALL SELECT sector, month, 'brier', round(brier, 6) FROM cl
  UNION ALL SELECT sector, month, 'auc', round(CASE WHEN n1 BETWEEN 1 AND n - 1 THEN (sr - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END, 6) FROM cl
)
SELECT sector, metric, round(avg(x), 5) AS mean FROM (SELECT * FROM l WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sector, metric ORDER BY month DESC) <= 4) GROUP BY ALL""",
    "perf_status": f"WITH {_PERF} SELECT sector, metric, mean, status FROM ps",
    "perf_overall": f"WITH {_PERF} SELECT sector, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM ps GROUP BY sector",
    "dq_ohlc": _bad("stg_prices", _OHLC, "row_id"),
    "dq_return_ranges": "SELECT DISTINCT * FROM (" + _bad("fct_returns_daily", {"between:log_return": "log_return BETWEEN -0.1 AND 0.1", "between:next_log_return": "next_log_return BETWEEN -0.1 AND 0.1"}, "ticker, trade_date, loaded_at") + ")",
    "dq_label_null": "SELECT DISTINCT * FROM ("
    + _bad("fct_returns_daily", {"label_null_iff_return_null": "(next_log_return IS NULL) = (next_return_positive IS NULL)", "label_sign": "(next_log_return > 0) = next_return_positive"}, "ticker, trade_date, loaded_at")
    + ")",
    "dq_label_damaged": f"WITH {_PANEL}, {_DAMAGED} "
    + _bad("dm", {"label_null_iff_return_null": "(nr IS NULL) = (label IS NULL)", "label_sign": "(nr > 0) = label"}, "ticker, trade_date"),
    "dq_pit_damaged": f"WITH {_PANEL}, {_DAMAGED} SELECT ticker, count(*) FILTER (r IS NULL) AS null_returns, count(*) FILTER (label IS NULL) AS null_labels FROM dm GROUP BY ticker HAVING null_returns <> 1 OR null_labels <> 1",
    "dq_failure_cases": "WITH b AS (SELECT rule, concat_ws(' ', source, ticker, CAST(trade_date AS VARCHAR)) AS k FROM (" + _bad("stg_prices", _OHLC, "source, ticker, trade_date") + """)),
t AS (SELECT rule, string_agg(k, ',' ORDER BY k) AS examples FROM (SELECT * FROM (SELECT DISTINCT rule, k FROM b) QUALIFY row_number() OVER (PARTITION BY rule ORDER BY k) <= 10) GROUP BY rule)
SELECT rule, count(*) AS n_rows, any_value(examples) AS examples FROM b JOIN t USING (rule) GROUP BY rule""",
    "prices_sliced": "SELECT ticker, trade_date, close, volume FROM fct_prices_daily WHERE trade_date BETWEEN DATE '2021-04-01' AND DATE '2021-12-31' AND trade_date IN (SELECT trade_date FROM int_macro_daily WHERE value IS NOT NULL)",
    "dq_macro_pit": _bad("int_macro_daily", {"vintage_not_later": "vintage_date <= trade_date", "observation_not_later": "observation_date <= trade_date"}, "row_id"),
    "dq_facts_pit": _bad("int_fundamentals_pit", {"filed_not_later": "filed_used <= trade_date", "period_ended": "period_end_used <= filed_used"}, "row_id"),
    "dq_vintage_dup": "SELECT series_id, observation_date, vintage_date, count(*) AS n FROM stg_macro_series GROUP BY ALL HAVING count(*) > 1",
    "dq_benchmark_present": "SELECT DISTINCT trade_date FROM fct_prices_daily WHERE trade_date NOT IN (SELECT trade_date FROM fct_prices_daily WHERE is_benchmark)",
    "dq_pit_boundaries": f"""WITH {_PANEL} SELECT ticker, count(*) FILTER (r IS NULL) AS null_returns, count(*) FILTER (nr IS NULL) AS null_labels FROM lab GROUP BY ticker HAVING null_returns <> 1 OR null_labels <> 1""",
    "dq_contract_counts": _CONTRACTS,
    "dq_raw_by_ticker": "SELECT source, ticker, count(*) AS n_rows, "
    + " + ".join(f"CAST(count(*) FILTER (NOT coalesce({r}, TRUE)) > 0 AS BIGINT)" for r in _RULES["stg_prices"][0].values()) + " AS failed, "
    + " + ".join(f"count(*) FILTER (NOT coalesce({r}, TRUE))" for r in _RULES["stg_prices"][0].values()) + " AS violations FROM stg_prices GROUP BY ALL",
    "dq_first_violation": "WITH d AS (SELECT source, ticker, trade_date, count(*) = 1 AS r0, " + ", ".join(f"bool_and(coalesce({r}, TRUE)) AS r{i}" for i, r in enumerate(_BARS.values(), 1)) + " FROM stg_prices GROUP BY ALL), b AS ("
    + " UNION ALL ".join(f"SELECT source, ticker, trade_date, {i} AS k, '{n}' AS rule FROM d WHERE NOT r{i}" for i, n in enumerate(("duplicate", *_BARS)))
    + """) SELECT source, ticker, rule, string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) AS dates
FROM (SELECT * FROM b QUALIFY k = min(k) OVER (PARTITION BY source, ticker)) GROUP BY ALL""".replace("(SELECT * FROM b QUALIFY", "(SELECT * FROM (SELECT * FROM b QUALIFY").replace("source, ticker)) GROUP", "source, ticker)) QUALIFY row_number() OVER (PARTITION BY source, ticker ORDER BY trade_date) <= 3) GROUP"),
    "dq_bar_events": "SELECT DISTINCT source, ticker, trade_date, source || ':' || ticker || ':' || CAST(trade_date AS VARCHAR) || ':' || sha256("
    + _framed("source", "ticker", "CAST(trade_date AS VARCHAR)", *(f"CAST(CAST(round({c}, 6) AS DECIMAL(38,6)) AS VARCHAR)" for c in ("open", "high", "low", "close", "adj_close")), "CAST(volume AS VARCHAR)")
    + ") AS idempotency_key FROM stg_prices WHERE length(source) >= 1 AND length(ticker) BETWEEN 1 AND 16 AND trade_date IS NOT NULL AND " + " AND ".join(f"({r})" for r in _BARS.values()),
    "dq_gate": f"SELECT contract, count(*) FILTER (violations > 0) AS failed, count(*) FILTER (violations > 0) = 0 AS passed FROM ({_CONTRACTS}) GROUP BY contract",
    "dq_orphans": "SELECT DISTINCT ticker FROM stg_prices WHERE ticker NOT IN (SELECT ticker FROM ticker_metadata)",
    "ingest_normalise": """SELECT source || ':' || ticker AS ticker, trade_date, open, high, low, close, coalesce(adj_close, close) AS adj_close, coalesce(volume, 0) AS volume FROM stg_prices
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, ticker, trade_date ORDER BY row_id DESC) = 1""",
    "missing_sentinel_parse": """SELECT report_id, count(*) AS n, count(CASE WHEN isfinite(TRY_CAST(trim(psi) AS DOUBLE)) THEN 1 END) AS n_numbers FROM drift_features GROUP BY report_id""",
    "json_facts_flatten": _FLAT,
    "json_facts_messy": _FLAT,
    "snapshot_hash": "WITH h AS (SELECT source, load_id, sha256("
    + _framed("ticker", "CAST(trade_date AS VARCHAR)", "CAST(CAST(round(close, 4) AS DECIMAL(38,4)) AS VARCHAR)", "CAST(CAST(round(high, 4) AS DECIMAL(38,4)) AS VARCHAR)", "CAST(volume AS VARCHAR)")
    + """) AS s FROM stg_prices),
w AS (SELECT source, load_id, count(*) AS n_rows, """
    + ", ".join(f"CAST(sum(CAST('0x' || substring(s, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR) AS w{i}" for i in range(4))
    + """ FROM h GROUP BY ALL)
SELECT source, load_id, sha256(n_rows || '|' || w0 || '|' || w1 || '|' || w2 || '|' || w3) AS content_hash, n_rows FROM w""",
    "snapshot_store_returns": "SELECT source, load_id, ticker, trade_date, close, row_id FROM stg_prices WHERE row_id % 2 = 0",
    "snapshot_retention": "SELECT source, ticker, arg_max(path, (last_date, written_at, path)) AS path FROM manifest WHERE path IS NOT NULL GROUP BY ALL",
    "sample_exact_n": "SELECT row_id, ticker, close, (SELECT count(*) FROM stg_prices) AS n_total FROM stg_prices ORDER BY md5(CAST(row_id AS VARCHAR) || '|42') LIMIT 1000",
}
