"""SQL text of the views, for the oracle side, and helpers to compose oracle queries."""

from __future__ import annotations

PX = """
  WITH li AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS t
              FROM lineitem GROUP BY l_orderkey)
  SELECT r_name AS market, CAST(o_orderdate AS DATE) AS date,
         floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100000 AS close,
         floor(CAST(sum(t) AS DOUBLE) / sum(q)) / 100 AS vwap, sum(q) AS volume, CAST(sum(t) AS DOUBLE) / 100 AS turnover
  FROM orders JOIN li ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY r_name, CAST(o_orderdate AS DATE)"""

CAL = """
  SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '05-01', '10-01', '10-02', '10-03') AS is_open
  FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM px)"""

PANEL = """
  SELECT m.market, c.date, p.close, p.vwap, coalesce(p.volume, 0) AS volume, coalesce(p.turnover, 0) AS turnover,
         c.is_open, p.volume IS NOT NULL AS has_trade, c.is_open AND p.volume IS NULL AS is_quiet
  FROM cal c CROSS JOIN (SELECT DISTINCT market FROM px) m LEFT JOIN px p ON p.market = m.market AND p.date = c.date"""

IND = """
  SELECT concat('M_', l_returnflag) AS indicator, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100 AS value
  FROM lineitem GROUP BY l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE)
  UNION ALL SELECT concat('Q_', l_linestatus), CAST(date_trunc('quarter', l_shipdate) AS DATE),
         floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100
  FROM lineitem GROUP BY l_linestatus, CAST(date_trunc('quarter', l_shipdate) AS DATE)
  UNION ALL SELECT 'D_ALL', CAST(l_shipdate AS DATE),
         floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE)"""

SCORED = """
  SELECT doc_id, text, lang, n_chars,
         CASE doc_id % 3 WHEN 0 THEN 'national' WHEN 1 THEN 'regional_a' ELSE 'regional_b' END AS source,
         DATE '1995-01-02' + CAST(doc_id * 37 % 2400 AS INTEGER) AS publish_date,
         CAST(doc_id * 7919 % 301 AS DOUBLE) - 150 AS supply, CAST(doc_id * 104729 % 301 AS DOUBLE) - 150 AS demand,
         CAST(doc_id * 1299709 % 151 AS DOUBLE) AS strength
  FROM documents"""

PRED = """
  SELECT market, date, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred,
         CASE WHEN close > prev THEN 1 ELSE 0 END AS actual, close
  FROM (SELECT market, date, close, lag(close) OVER (PARTITION BY market ORDER BY date) AS prev,
               CAST((date_diff('day', DATE '1995-01-01', date) * 31 + length(market) * 17) % 1000 AS DOUBLE) / 1000 AS prob
        FROM px) WHERE prev IS NOT NULL"""

# Three models per market: always long, close above its 20-row mean, and a probability above one half. The test prices
# are independent draws, on which buying low pays without limit, so the models trade a price damped to a hundredth.
SIG = """
  SELECT model, market, date, 100 + close / 100 AS close,
         CASE model WHEN 'Buy&Hold' THEN 1
                    WHEN 'Trend' THEN CASE WHEN c20 = 20 AND s20 < close * 20 THEN 1 ELSE 0 END
                    ELSE CASE WHEN prob > 0.5 THEN 1 ELSE 0 END END AS signal
  FROM (SELECT market, date, close,
               CAST(sum(CAST(round(close * 100000) AS BIGINT)) OVER (PARTITION BY market ORDER BY date ROWS 19 PRECEDING) AS DOUBLE) / 100000 AS s20,
               count(close) OVER (PARTITION BY market ORDER BY date ROWS 19 PRECEDING) AS c20,
               CAST((date_diff('day', DATE '1995-01-01', date) * 31 + length(market) * 17) % 1000 AS DOUBLE) / 1000 AS prob
        FROM px) CROSS JOIN (SELECT unnest(['Buy&Hold', 'Trend', 'Prob']) AS model)"""

# Frictionless value: the lagged signal holds the position, so value moves with the price while it was 1 a row before.
NAV = """
  SELECT model, market, date, round(1000000 * exp(sum(step) OVER (PARTITION BY model, market ORDER BY date ROWS UNBOUNDED PRECEDING)), 2) AS nav
  FROM (SELECT model, market, date, CASE WHEN coalesce(lag(pos) OVER w, 0) = 1 THEN ln(close / lag(close) OVER w) ELSE 0 END AS step
        FROM (SELECT model, market, date, close, coalesce(lag(signal) OVER (PARTITION BY model, market ORDER BY date), 0) AS pos FROM sig)
        WINDOW w AS (PARTITION BY model, market ORDER BY date))"""

RET = """
  SELECT * FROM (SELECT model, market, date, nav, nav / lag(nav) OVER (PARTITION BY model, market ORDER BY date) - 1 AS r FROM nav)
  WHERE r IS NOT NULL"""

WEEK = """
  SELECT market, max(date) AS date, arg_max(close, date) AS close FROM px GROUP BY market, date_trunc('week', date) HAVING count(*) >= 3"""

# Costed value at cost 0.1 % and slippage 0.05 %.
POS = """
  WITH a AS (SELECT model, market, date, close, CASE WHEN coalesce(lag(signal) OVER w, 0) > 0 THEN 1 ELSE 0 END AS held FROM sig WINDOW w AS (PARTITION BY model, market ORDER BY date)),
  b AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY model, market ORDER BY date), 0) AS was FROM a),
  c AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN 'buy' WHEN held = 0 AND was = 1 THEN 'sell' END AS action,
          last_value(CASE WHEN held = 1 AND was = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY model, market ORDER BY date ROWS UNBOUNDED PRECEDING) AS entry FROM b),
  d AS (SELECT *, 1000000 * exp(sum(CASE WHEN action = 'sell' THEN ln(0.000001::DOUBLE + 0.998001::DOUBLE * (0.9995::DOUBLE / 1.0005::DOUBLE) * close / entry) ELSE 0 END)
          OVER (PARTITION BY model, market ORDER BY date ROWS UNBOUNDED PRECEDING)) AS cash FROM c),
  e AS (SELECT *, CASE WHEN held = 1 THEN cash * (0.000001::DOUBLE + 0.999::DOUBLE / 1.0005::DOUBLE * close / entry) ELSE cash END AS nav,
          CASE WHEN held = 1 THEN cash * 0.999::DOUBLE / (entry * 1.0005::DOUBLE) ELSE 0 END AS units FROM d),
  f AS (SELECT *, CASE action WHEN 'buy' THEN units WHEN 'sell' THEN lag(units) OVER (PARTITION BY model, market ORDER BY date) END AS trade_units,
          CASE action WHEN 'buy' THEN close * 1.0005::DOUBLE WHEN 'sell' THEN close * 0.9995::DOUBLE END AS trade_price FROM e)
  SELECT model, market, date, close, nav, units, action, trade_units, trade_price, trade_units * trade_price * 0.001::DOUBLE AS trade_cost FROM f"""

DD = """
  SELECT model, market, date, nav, peak, (nav - peak) / peak AS dd
  FROM (SELECT *, max(nav) OVER (PARTITION BY model, market ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM nav)"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), PX),
    "cal": (("px",), CAL),
    "panel": (("px", "cal"), PANEL),
    "ind": ((), IND),
    "scored": ((), SCORED),
    "pred": (("px",), PRED),
    "sig": (("px",), SIG),
    "nav": (("sig",), NAV),
    "ret": (("nav",), RET),
    "week": (("px",), WEEK),
    "wsig": (("week",), SIG.replace("FROM px", "FROM week")),
    "wnav": (("wsig",), NAV.replace("FROM sig)", "FROM wsig)")),
    "wret": (("wnav",), RET.replace("FROM nav)", "FROM wnav)")),
    "pos": (("sig",), POS),
    "dd": (("nav",), DD),
}


def _rounded(sql: str) -> str:
    """Expand ``Rk(expr)`` to ``round(expr, k)`` with a positive zero."""
    for places in range(1, 10):
        mark = f"R{places}("
        while mark in sql:
            start = sql.index(mark)
            depth, i = 1, start + len(mark)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                i += 1
            sql = f"{sql[:start]}(round({sql[start + len(mark):i - 1]}, {places}) + 0.0){sql[i:]}"
    return sql


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """Put the views a query uses, in dependency order, before its own text."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    body = _rounded(sql.strip())
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    lead = body.split(None, 2)
    if lead[0].upper() == "WITH":
        recursive = lead[1].upper() == "RECURSIVE"
        rest = body[len("WITH"):].lstrip()
        if recursive:
            rest = rest[len("RECURSIVE"):].lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{body}"
