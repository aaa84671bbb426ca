"""The SQL each query must agree with, written from the definitions for DuckDB.

Fragments are named common table expressions; ``_sql`` puts the needed ones in front of a body.
Doubles are rounded to six places (plus 0.0, which turns a negative zero into zero), dates are
text, counts BIGINT.
"""

from __future__ import annotations

from sigtide import constants as K
from sigtide.functions.text import WHITE_SPACE
from sigtide.operators.backtest import SHOWN
from sigtide.plans import bindings as B
from sigtide.plans.queries import STRATEGIES

_CTE: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    _CTE[name] = body
    _NEEDS[name] = needs


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(_NEEDS[name], seen)
            seen.append(name)
    return seen


def _sql(body: str, *names: str) -> str:
    parts = [f"{n} AS ({_CTE[n]})" for n in _order(names, [])]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def _r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(index: str, *values: str) -> str:
    return f"{_list(values)}[({index}) % {len(values)} + 1]"


def _day(key: str) -> str:
    return f"(DATE '{B.START}' + CAST({key} % 30 AS INTEGER))"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}_' || substr(sha256({key}), 1, 16)"


def _strip(col: str) -> str:
    return f"trim({col}, '{WHITE_SPACE}')"


# ---- fragments -----------------------------------------------------------------------------------

_cte("docs", f"""SELECT doc_id, {_id('doc', 'CAST(doc_id AS VARCHAR)')} AS id, source,
  lang AS source_type, text AS body, {_day('doc_id')} AS date FROM documents""")
_cte("clean", f"""SELECT * FROM (SELECT doc_id, id, source, source_type, date,
  {_strip('body')} AS body FROM docs) WHERE length(body) > 20""", "docs")
_cte("words", r"""SELECT *, list_filter(string_split_regex(lower(body), '[^\p{L}]+'),
  lambda t: t <> '') AS w FROM clean""", "clean")
_cte("hits", f"""SELECT *, len(list_filter(w, lambda t: list_contains({_list(B.POSITIVE)}, t))) AS p,
  len(list_filter(w, lambda t: list_contains({_list(B.NEGATIVE)}, t))) AS g, len(w) AS n
  FROM words""", "words")
_cte("shares", """SELECT *, (p + 1.0) / (p + g + (n - p - g) * CAST(0.05 AS DOUBLE) + 3.0) AS positive,
  (g + 1.0) / (p + g + (n - p - g) * CAST(0.05 AS DOUBLE) + 3.0) AS negative,
  ((n - p - g) * CAST(0.05 AS DOUBLE) + 1.0) / (p + g + (n - p - g) * CAST(0.05 AS DOUBLE) + 3.0)
  AS neutral FROM hits""", "hits")
_cte("scores", """SELECT id, source, source_type, date, positive, negative, neutral,
  positive - negative AS composite, length(body) AS text_length FROM shares""", "shares")
_cte("sent", """SELECT date, avg(composite) AS cross_composite, avg(positive) AS cross_positive,
  avg(negative) AS cross_negative, count(composite) AS cross_count FROM scores GROUP BY date""",
     "scores")
_SOURCE_AGGS = ", ".join([
    _r("avg(composite)", "mean_composite"), _r("avg(positive)", "mean_positive"),
    _r("avg(negative)", "mean_negative"), _r("stddev_samp(composite)", "std_composite"),
    "count(composite) AS count", _r("avg(text_length)", "mean_text_length")])

_cte("news", """SELECT CAST(ts AS DATE) AS date,
  coalesce(CASE WHEN event_type = 'error' THEN -least(value / 10.0, 10.0)
    WHEN event_type <> 'view' THEN least(value / 10.0, 10.0) END, 0.0) / 10.0 AS g,
  (CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50.0 + value / 1000.0) / 100.0 AS t FROM events""")
_cte("geo0", """SELECT date, avg(g) AS mean_goldstein, stddev_samp(g) AS std_goldstein,
  avg(t) AS mean_tone, count(*) FILTER (g < -0.3) AS conflict_events,
  count(*) FILTER (g > 0.3) AS cooperation_events, count(g) AS total_events
  FROM news GROUP BY date""", "news")
_cte("geo", """SELECT *, greatest(-1.0, least(1.0,
  -0.6 * mean_goldstein + 0.4 * conflict_ratio)) AS geopolitical_risk_score FROM (
  SELECT *, conflict_events / greatest(total_events, 1) AS conflict_ratio FROM geo0)""", "geo0")
_GEO = ", ".join(["CAST(date AS VARCHAR) AS date", _r("mean_goldstein"), _r("std_goldstein"),
                  _r("mean_tone"), "conflict_events", "cooperation_events", "total_events",
                  _r("conflict_ratio"), _r("geopolitical_risk_score")])

# topics
_cte("assigned", """SELECT d.*, CAST(coalesce(e.label, -1) AS BIGINT) AS topic_id FROM docs d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id""", "docs")
_cte("topic_tokens", r"""SELECT topic_id, unnest(list_filter(string_split_regex(lower(body),
  '[^\p{L}]+'), lambda t: t <> '')) AS word FROM assigned""", "assigned")
_cte("topic_counts", """SELECT topic_id, word, count(*) AS n FROM topic_tokens
  GROUP BY topic_id, word""", "topic_tokens")
_cte("tfidf", """SELECT topic_id, word, n, n * ln(1.0 + m / f) AS score FROM (
  SELECT *, sum(n) OVER (PARTITION BY word) AS f,
    (SELECT avg(t) FROM (SELECT sum(n) AS t FROM topic_counts GROUP BY topic_id)) AS m
  FROM topic_counts)""", "topic_counts")
_cte("top_words", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id
  ORDER BY round(score, 9) DESC, word) AS rank FROM tfidf) WHERE rank <= 10""", "tfidf")
_cte("topic_text", """SELECT topic_id, lower(string_agg(word, ' ' ORDER BY rank)) AS txt
  FROM top_words GROUP BY topic_id""", "top_words")
_cte("label_hits", "SELECT topic_id, label, ord, h FROM topic_text, LATERAL (VALUES " + ", ".join(
    f"('{label}', {i}, " + " + ".join(f"CAST(contains(txt, '{w}') AS INTEGER)" for w in ws) + ")"
    for i, (label, ws) in enumerate(B.TOPIC_WORDS.items())) + ") v(label, ord, h)", "topic_text")
_cte("topic_labels", """SELECT topic_id, CASE WHEN topic_id = -1 THEN 'noise'
  WHEN max(h) = 0 THEN 'other' ELSE first(label ORDER BY h DESC, ord) END AS macro_label
  FROM label_hits GROUP BY topic_id""", "label_hits")
_cte("labelled", """SELECT a.*, coalesce(l.macro_label, 'other') AS macro_label
  FROM assigned a LEFT JOIN topic_labels l USING (topic_id)""", "assigned", "topic_labels")
_LABELS = [*K.MACRO_TOPICS, K.TOPIC_OTHER, K.TOPIC_NOISE]
_cte("topic_days", "SELECT date, " + ", ".join(
    f"count(*) FILTER (macro_label = '{x}') AS {x}" for x in _LABELS)
    + " FROM labelled GROUP BY date", "labelled")

# markets
_SERIES = ("KXFED", "KXCPI", "KXFEDDECISION", "KXRATECUTCOUNT", "KXGDP", "KXUNEMP", "KXINFL",
           "KXRECESSION")


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(tt, '{w}')" for w in words) + ")"


_cte("market0", f"""SELECT {_day('p_partkey')} AS date, {_pick('p_partkey', *_SERIES)} AS series,
  {_pick('p_partkey', *_SERIES)} || '-' || {_pick('p_partkey', '26APR', '26JUN', '26MAY')}
    AS event_ticker,
  {_pick('p_size', 'T', 'B', 'U', 'A', 'H', 'X')} || CAST(p_size // 10 AS VARCHAR) || '.'
    || CAST(p_size % 10 AS VARCHAR) AS tail,
  coalesce(nullif({_pick('p_partkey // 8', 'Rate above target', 'Rate cut',
    'Government spending', 'Hold', 'Will it be lower', '', 'Recession odds')}, ''), p_name) AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN round((p_retailprice - 900.0) / 100.0, 3) ELSE 0.0 END AS yes_bid,
  CASE WHEN p_partkey % 7 <> 0 THEN round((p_retailprice - 898.0) / 100.0, 3) ELSE 0.0 END AS yes_ask,
  CASE WHEN p_partkey % 11 <> 0 THEN p_size / 50.0 ELSE 0.0 END AS last_price,
  coalesce(oi, 0.0) AS open_interest FROM part LEFT JOIN (
    SELECT l_partkey, sum(l_quantity) AS oi FROM lineitem GROUP BY l_partkey
  ) ON l_partkey = p_partkey""")
_cte("market1", f"""SELECT *, event_ticker || '-' || tail AS ticker, upper(title) AS tt,
  regexp_extract(event_ticker || '-' || tail, '{K.THRESHOLD_PATTERN}', 1) AS letter,
  TRY_CAST(regexp_extract(event_ticker || '-' || tail, '{K.THRESHOLD_PATTERN}', 2) AS DOUBLE)
    AS threshold FROM market0""", "market0")
_cte("markets", f"""SELECT *, CASE
  WHEN series = 'KXRECESSION' OR contains(upper(ticker), 'RECESSION') OR contains(tt, 'RECESSION')
    THEN -1.0
  WHEN series = 'KXRATECUTCOUNT' THEN 0.6
  WHEN series = 'KXFEDDECISION' THEN CASE WHEN letter = 'H' OR {_has(K.HIKE_WORDS)} THEN -0.8
    WHEN {_has(K.CUT_WORDS)} THEN 0.6 ELSE 0.3 END
  WHEN series = 'KXFED' THEN CASE WHEN threshold >= 4.25 THEN -0.7 WHEN threshold < 4.25 THEN 0.7
    WHEN {_has(K.HIKE_WORDS)} THEN -0.7 WHEN {_has(K.CUT_WORDS)} THEN 0.7 ELSE 0.0 END
  WHEN series IN ('KXCPI', 'KXINFL') THEN CASE
    WHEN letter IN ('A', 'T') OR {_has(K.HOT_INFLATION_WORDS)} THEN -0.6
    WHEN letter = 'B' OR {_has(K.COOL_INFLATION_WORDS)} THEN 0.4 ELSE -0.3 END
  WHEN series = 'KXGDP' THEN CASE WHEN letter IN ('A', 'T') OR {_has(K.GDP_UP_WORDS)} THEN 0.5
    WHEN letter = 'B' OR {_has(K.GDP_DOWN_WORDS)} THEN -0.5 ELSE 0.0 END
  WHEN series = 'KXUNEMP' THEN CASE
    WHEN letter IN ('A', 'T') OR {_has(K.UNEMPLOYMENT_UP_WORDS)} THEN -0.4
    WHEN letter = 'B' OR {_has(K.UNEMPLOYMENT_DOWN_WORDS)} THEN 0.3 ELSE 0.0 END
  ELSE 0.0 END::DOUBLE AS w,
  CASE WHEN yes_bid <> 0 OR yes_ask <> 0 THEN (yes_bid + yes_ask) / 2.0
    WHEN last_price <> 0 THEN last_price END AS mid_price FROM market1""", "market1")
_cte("market_days", """SELECT date,
  greatest(-1.0, least(1.0, coalesce(sum(s * wt) / nullif(sum(wt), 0), 0.0))) AS kalshi_regime_scalar,
  count(*) AS kalshi_n_markets, count(*) FILTER (w <> 0) AS kalshi_n_weighted_markets,
  coalesce(sum(open_interest) FILTER (w <> 0), 0.0) AS kalshi_total_open_interest FROM (
    SELECT *, CASE WHEN w <> 0 AND mid_price IS NOT NULL
        THEN (greatest(0.0, least(1.0, mid_price)) - 0.5) * 2.0 * w END AS s,
      CASE WHEN w <> 0 AND mid_price IS NOT NULL THEN greatest(open_interest, 1.0) END AS wt
    FROM markets) GROUP BY date""", "markets")
_MARKET_DAY = ", ".join(["CAST(date AS VARCHAR) AS date", _r("kalshi_regime_scalar"),
                         "kalshi_n_markets", "kalshi_n_weighted_markets",
                         _r("kalshi_total_open_interest")])

# macro series and regimes
_cte("writes", """SELECT CAST(ts AS DATE) AS date, ts, event_id, event_type, value / 2.0 AS value
  FROM events""")
_cte("all_points", """SELECT date, last(value ORDER BY ts, event_id) AS value FROM writes
  GROUP BY date""", "writes")
_cte("points", "SELECT * FROM all_points WHERE day(date) % 3 <> 0", "all_points")
_cte("event_days", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events")


def _interpolated(points: str) -> str:
    return f"""SELECT CAST(s.d AS DATE) AS date, CASE WHEN s.d = a.date THEN a.value ELSE
  a.value + (b.value - a.value) * (CAST(s.d AS DATE) - a.date) / (b.date - a.date) END AS value
  FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM {points}) s
  JOIN {points} a ON a.date = (SELECT max(date) FROM {points} p WHERE p.date <= s.d)
  LEFT JOIN {points} b ON b.date = (SELECT min(date) FROM {points} p WHERE p.date > s.d)"""


def _regimes(days: str, series: str) -> str:
    """Clamp to the observed range (every day inside it exists), then bin."""
    return f"""SELECT d.*, s.value AS vix, CASE WHEN s.value <= 15 THEN 'risk_on'
  WHEN s.value <= 25 THEN 'transition' WHEN s.value IS NOT NULL THEN 'risk_off' END AS regime
  FROM {days} d, (SELECT min(date) AS lo, max(date) AS hi FROM {series}) r
  LEFT JOIN {series} s ON s.date = greatest(r.lo, least(r.hi, d.date))"""


_cte("vix", _interpolated("points"), "points")
_cte("long_points", """SELECT CAST(o_orderdate AS DATE) AS date,
  avg(o_totalprice) / 12500.0 AS value FROM orders GROUP BY 1""")
_cte("long_vix", """SELECT CAST(unnest(generate_series(d0, coalesce(d1 - 1, d0),
  INTERVAL 1 DAY)) AS DATE) AS date, d0, d1, v0, v1 FROM (SELECT date AS d0, value AS v0,
  lead(date) OVER (ORDER BY date) AS d1, lead(value) OVER (ORDER BY date) AS v1
  FROM long_points)""", "long_points")
_cte("long_series", """SELECT date, CASE WHEN date = d0 THEN v0
  ELSE v0 + (v1 - v0) * (date - d0) / (d1 - d0) END AS value FROM long_vix""", "long_vix")
_cte("panel", """SELECT coalesce(o.date, l.date) AS date, coalesce(n_orders, 0) AS n_orders,
  coalesce(max_price, 0) AS max_price, coalesce(min_price, 0) AS min_price,
  coalesce(std_price, 0) AS std_price, coalesce(n_lines, 0) AS n_lines,
  coalesce(mean_discount, 0) AS mean_discount, coalesce(quantity, 0) AS quantity,
  CAST(o.date IS NULL AS BIGINT) AS part0_missing, CAST(l.date IS NULL AS BIGINT) AS part1_missing
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders, max(o_totalprice) AS max_price,
    min(o_totalprice) AS min_price, stddev_samp(o_totalprice) AS std_price FROM orders GROUP BY 1) o
  FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n_lines,
    avg(l_discount) AS mean_discount, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l
  ON o.date = l.date""")

# prices, signals, alignment
_cte("prices", """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker,
  100.0 + max(o_totalprice) / 10000.0 AS close FROM orders GROUP BY 1, 2""")
_cte("returns", "SELECT *, " + ", ".join(
    f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1.0 AS fwd_{h}d"
    for h in K.HORIZONS) + " FROM prices", "prices")
_cte("shares3", """SELECT CAST(o_orderdate AS DATE) AS date,
  count(*) FILTER (o_orderstatus = 'F') / count(*) AS risk_on_prob,
  count(*) FILTER (o_orderstatus = 'O') / count(*) AS risk_off_prob,
  count(*) FILTER (o_orderstatus = 'P') / count(*) AS transition_prob, count(*) AS n_orders
  FROM orders GROUP BY 1""")
_cte("signals", """SELECT date, CASE WHEN risk_on_prob >= risk_off_prob
    AND risk_on_prob >= transition_prob THEN 'risk_on'
    WHEN risk_off_prob >= transition_prob THEN 'risk_off' ELSE 'transition' END AS regime,
  greatest(risk_on_prob, risk_off_prob, transition_prob) AS confidence, risk_on_prob,
  risk_off_prob, transition_prob FROM shares3""", "shares3")
_cte("gap_signals", "SELECT * FROM signals WHERE day(date) % 7 <> 0", "signals")
_cte("filled", "SELECT date, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}"
    for c in ("regime", "risk_on_prob", "risk_off_prob", "transition_prob")) + """ FROM (
  SELECT d.date, s.* EXCLUDE (date) FROM (SELECT DISTINCT date FROM returns) d
  LEFT JOIN gap_signals s USING (date))""", "returns", "gap_signals")
_cte("aligned", "SELECT * FROM returns LEFT JOIN filled USING (date)", "returns", "filled")

# validation
_cte("signed", """SELECT *, CASE WHEN ticker IN ('1-URGENT', '2-HIGH') THEN risk_on_prob
  ELSE -risk_off_prob END AS signal FROM aligned WHERE ticker <> '5-LOW'""", "aligned")
_cte("pairs", " UNION ALL ".join(
    f"SELECT ticker, {h}::BIGINT AS horizon, date, signal, fwd_{h}d AS ret FROM signed "
    f"WHERE signal IS NOT NULL AND fwd_{h}d IS NOT NULL" for h in K.HORIZONS), "signed")
_cte("numbered", """SELECT *, row_number() OVER (PARTITION BY ticker, horizon ORDER BY date) - 1 AS i
  FROM pairs""", "pairs")


def _spearman(source: str, key: str) -> str:
    """Pearson of average ranks within each key, NULL when a side is constant."""
    return f"""SELECT {key}, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)
  AS rho FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY signal)
      + (count(*) OVER (PARTITION BY {key}, signal) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY {key} ORDER BY ret)
      + (count(*) OVER (PARTITION BY {key}, ret) - 1) / 2.0 AS b FROM {source}) GROUP BY {key}"""


_cte("win_a", f"""SELECT e.ticker, e.horizon, e.i AS e, p.signal, p.ret FROM numbered e JOIN numbered p
  ON p.ticker = e.ticker AND p.horizon = e.horizon AND p.i BETWEEN e.i - {K.ROLLING_WINDOW} AND e.i - 1
  WHERE e.i >= {K.ROLLING_WINDOW}""", "numbered")
_cte("rho_a", _spearman("win_a", "ticker, horizon, e"), "win_a")
_cte("ir", """SELECT ticker, horizon, avg(rho) AS m, stddev_samp(rho) AS s FROM rho_a
  GROUP BY ticker, horizon""", "rho_a")
_cte("full_ic", _spearman("pairs", "ticker, horizon"), "pairs")
_cte("hit", """SELECT ticker, horizon, avg(CASE WHEN sign(signal) = sign(ret) THEN 1.0 ELSE 0.0 END)
  AS hit_rate FROM pairs GROUP BY ticker, horizon""", "pairs")
# p-value: v = n - 2, theta = asin |rho|; a_k and b_k as running products in logarithms
_cte("p_terms", """SELECT ticker, horizon, rho, n - 2 AS v, k, CASE WHEN (n - 2) % 2 = 1
    THEN CASE WHEN k = 1 THEN 0.5 * ln(1 - rho * rho)
      ELSE ln(1 - rho * rho) + ln((2 * k - 2) / (2 * k - 1)) END
    ELSE CASE WHEN k = 1 THEN 0.0 ELSE ln(1 - rho * rho) + ln((2 * k - 3) / (2 * k - 2)) END
  END AS lt FROM (SELECT *, unnest(range(1, CAST((n - 2) // 2 + 1 AS BIGINT))) AS k FROM full_ic
    WHERE n >= 30 AND abs(rho) < 1)""", "full_ic")
_cte("p_sum", """SELECT ticker, horizon, rho, v, sum(exp(c)) AS s FROM (SELECT *, sum(lt) OVER
  (PARTITION BY ticker, horizon ORDER BY k) AS c FROM p_terms) GROUP BY ticker, horizon, rho, v""",
     "p_terms")
_cte("p_value", """SELECT ticker, horizon, greatest(0.0, CASE WHEN v % 2 = 1
  THEN 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * s) ELSE 1 - abs(rho) * s END) AS p FROM p_sum""",
     "p_sum")
_cte("rows_b", """SELECT ticker, date, signal, fwd_1d AS ret,
  row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM signed""", "signed")
_cte("win_b", f"""SELECT e.ticker, e.date, p.signal, p.ret FROM rows_b e JOIN rows_b p
  ON p.ticker = e.ticker AND p.i BETWEEN e.i - {K.ROLLING_WINDOW} AND e.i - 1
  WHERE e.i >= {K.ROLLING_WINDOW} AND p.signal IS NOT NULL AND p.ret IS NOT NULL""", "rows_b")
_cte("rho_b", f"""SELECT ticker, date, rho FROM ({_spearman('win_b', 'ticker, date')})
  WHERE n >= {K.MIN_WINDOW_OBSERVATIONS} AND rho IS NOT NULL""", "win_b")

# back-test: positions by a plain recursive walk over the bars
_cte("sources", """SELECT date, unnest([
    {'s': 'sentiment', 'v': risk_on_prob - risk_off_prob},
    {'s': 'geopolitical', 'v': transition_prob - risk_off_prob},
    {'s': 'composite', 'v': (risk_on_prob - risk_off_prob) * CAST(0.6 AS DOUBLE)
      + (transition_prob - risk_off_prob) * CAST(0.4 AS DOUBLE)}]) AS x FROM shares3""", "shares3")
_cte("close", """SELECT CAST(o_orderdate AS DATE) AS date, 100.0 + max(o_totalprice) / 10000.0 AS close
  FROM orders GROUP BY 1""")
_cte("params", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, '{s.signal_source}', {s.lookback_days}::BIGINT, {s.entry_threshold}::DOUBLE, "
    f"{s.exit_threshold}::DOUBLE, {s.fees}::DOUBLE)" for i, s in enumerate(STRATEGIES))
    + ") t(strategy_id, signal_source, lookback_days, entry, leave, fees)")
_cte("bars", """SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS bar
  FROM (SELECT p.*, q.date, q.signal, q.close FROM params p JOIN (
    SELECT x.s AS source, date, x.v AS signal, close, row_number() OVER (PARTITION BY x.s
      ORDER BY date DESC) AS age FROM sources JOIN close USING (date)) q
  ON q.source = p.signal_source AND q.age <= p.lookback_days)""", "params", "sources", "close")
_cte("walk", """SELECT strategy_id, CAST(0 AS BIGINT) AS bar, CAST(0 AS BIGINT) AS position FROM params
  UNION ALL SELECT b.strategy_id, b.bar, CASE WHEN w.position = 0 AND b.signal > b.entry THEN 1
    WHEN w.position = 1 AND b.signal < b.leave THEN 0 ELSE w.position END
  FROM walk w JOIN bars b ON b.strategy_id = w.strategy_id AND b.bar = w.bar + 1""",
     "params", "bars")
_cte("held", """SELECT b.*, w.position, lag(w.position) OVER s AS held_before,
  coalesce(b.close / lag(b.close) OVER s - 1.0, 0.0) AS change
  FROM bars b JOIN walk w USING (strategy_id, bar)
  WINDOW s AS (PARTITION BY strategy_id ORDER BY bar)""", "bars", "walk")


def _curve(position: str) -> str:
    return f"""SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY bar) AS peak FROM (
  SELECT *, product(1.0 + period_return) OVER (PARTITION BY strategy_id ORDER BY bar) AS equity
  FROM (SELECT *, change * {position} AS period_return FROM held))"""


_cte("curve", _curve("position"), "held")
_cte("curve_lag", _curve("coalesce(held_before, 0)"), "held")
_cte("turns", """SELECT *, sum(CAST(position = 1 AND held_before = 0 AS BIGINT)) OVER
  (PARTITION BY strategy_id ORDER BY bar) AS trade_id FROM held""", "held")
_cte("trades", """SELECT o.strategy_id, o.trade_id, o.date AS entry_date, c.date AS exit_date,
  o.close * (1.0 + o.fees) AS entry_price, c.close * (1.0 - c.fees) AS exit_price,
  c.close * (1.0 - c.fees) / (o.close * (1.0 + o.fees)) - 1.0 AS trade_return
  FROM turns o JOIN turns c ON o.strategy_id = c.strategy_id AND o.trade_id = c.trade_id
  AND o.position = 1 AND o.held_before = 0 AND c.position = 0 AND c.held_before = 1""", "turns")
_cte("metrics0", """SELECT strategy_id, first(signal_source) AS signal_source,
  first(lookback_days) AS lookback_days, count(*) AS n_bars,
  last(equity ORDER BY bar) - 1.0 AS total_return,
  stddev_samp(period_return) FILTER (bar > 0) * sqrt(252) AS vol,
  stddev_samp(period_return) FILTER (bar > 0 AND period_return < 0) * sqrt(252) AS down,
  min((equity - peak) / peak) AS max_drawdown FROM curve GROUP BY strategy_id""", "curve")
_cte("metrics", """SELECT m.*, (1.0 + total_return) ** (252.0 / n_bars) - 1.0 AS ann,
  coalesce(t.n, 0) AS n_trades, coalesce(t.won, 0) / greatest(coalesce(t.n, 0), 1) AS win_rate
  FROM metrics0 m LEFT JOIN (SELECT strategy_id, count(*) AS n,
    count(*) FILTER (trade_return > 0) AS won FROM trades GROUP BY strategy_id) t
  USING (strategy_id)""", "metrics0", "trades")

_D = "CAST(date AS VARCHAR) AS date"


def _ratio(scale: str, name: str) -> str:
    return _r(f"coalesce(CASE WHEN {scale} > 0 THEN ann / {scale} END, 0.0)", name)


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    # geopolitics
    o["geo_daily"] = _sql(f"SELECT {_GEO} FROM geo", "geo")
    geo_cols = ", ".join([_D, _r("mean_goldstein"), _r("geopolitical_risk_score"),
                          _r("conflict_ratio"), "total_events"])
    o["geo_daily_tail"] = _sql(
        f"SELECT {geo_cols} FROM (SELECT * FROM geo ORDER BY date DESC LIMIT 10)", "geo")
    table = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {
        **K.CAMEO_CONFLICT, **K.CAMEO_COOPERATION}.items())
    o["cameo_score"] = f"""SELECT code, n, CASE WHEN code IS NULL OR length(code) < 2 THEN 0.0
  ELSE CASE substr(code, 1, 2) {table} ELSE CASE substr(code, 1, 1) WHEN '1' THEN -0.3
  WHEN '0' THEN 0.4 ELSE 0.0 END END END::DOUBLE AS score FROM (SELECT code, count(*) AS n FROM (
    SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '9' ELSE
      lpad(CAST((event_id * 7) % 45 AS VARCHAR), 2, '0') || CAST(event_id % 10 AS VARCHAR) END AS code
    FROM events) GROUP BY code)"""
    # text and sentiment
    o["text_clean"] = _sql(r"""SELECT doc_id, length(body) AS n_chars,
  CAST(length(body) >= 20 AS BIGINT) AS long_chars, strlen(body) AS n_bytes,
  md5(CASE WHEN body IN ('', '[removed]', '[deleted]') THEN source_type
    ELSE source_type || chr(10) || chr(10) || body END) AS body_md5 FROM clean""", "clean")
    o["record_id"] = _sql(
        f"""SELECT doc_id, {_id('doc', "'doc_' || body")} AS id FROM docs""", "docs")
    o["sentiment_scores"] = _sql("SELECT id, source, source_type, " + ", ".join([
        _D, _r("positive"), _r("negative"), _r("neutral"), _r("composite")])
        + ", text_length FROM scores", "scores")
    sent = ", ".join([_D, _r("cross_composite"), _r("cross_positive"), _r("cross_negative"),
                      "cross_count"])
    o["sentiment_daily"] = _sql(f"SELECT {sent} FROM sent", "sent")
    o["sentiment_tail"] = _sql(
        f"SELECT {sent} FROM (SELECT * FROM sent ORDER BY date DESC LIMIT 7)", "sent")
    o["sentiment_by_source"] = _sql(
        f"SELECT {_D}, source_type, {_SOURCE_AGGS} FROM scores s GROUP BY s.date, source_type",
        "scores")
    o["sentiment_rollup"] = _sql(
        f"SELECT {_D}, source_type, {_SOURCE_AGGS}, 0::BIGINT AS is_cross FROM scores s "
        f"GROUP BY s.date, source_type UNION ALL SELECT {_D}, NULL, {_SOURCE_AGGS}, 1::BIGINT "
        "FROM scores s GROUP BY s.date", "scores")
    # topics
    o["class_tfidf"] = _sql(f"SELECT topic_id, rank, word, n, {_r('score')} FROM top_words",
                            "top_words")
    o["macro_label"] = _sql("SELECT topic_id, macro_label FROM topic_labels", "topic_labels")
    o["topic_assign"] = _sql(
        f"SELECT id, source, source_type, {_D}, topic_id, macro_label FROM labelled", "labelled")
    pivot = ", ".join([_D, *_LABELS])
    o["topic_pivot"] = _sql(f"SELECT {pivot} FROM topic_days", "topic_days")
    o["topics_tail"] = _sql(
        f"SELECT {pivot} FROM (SELECT * FROM topic_days ORDER BY date DESC LIMIT 5)", "topic_days")
    totals = " UNION ALL ".join(
        f"SELECT '{x}' AS label, coalesce(sum({x}), 0)::BIGINT AS total FROM topic_days"
        for x in _LABELS)
    o["topic_top8"] = _sql(f"""SELECT label, total,
  {_r('total / greatest(max(total) OVER (), 1)', 'share')}, replace(label, '_', ' ') AS shown
  FROM (SELECT * FROM ({totals}) ORDER BY total DESC, label LIMIT 8)""", "topic_days")
    # markets
    o["market_records"] = _sql(f"""SELECT {_D}, ticker, title, series, event_ticker, {_r('yes_bid')},
  {_r('yes_ask')}, {_r('last_price')}, {_r('mid_price')}, {_r('open_interest')},
  0.0::DOUBLE AS volume, w AS directional_weight FROM markets""", "markets")
    followed = ", ".join(f"'{e}'" for e in K.MACRO_EVENTS)
    o["market_events"] = _sql(f"""SELECT event_ticker, count(*) AS n, {_r('sum(w)', 'weight')}
  FROM markets WHERE event_ticker IN ({followed}) GROUP BY event_ticker""", "markets")
    o["market_scalar"] = _sql(f"SELECT {_MARKET_DAY} FROM market_days", "market_days")
    o["market_tail"] = _sql(f"""SELECT {_MARKET_DAY} FROM (
  SELECT * FROM market_days ORDER BY date DESC LIMIT 12)""", "market_days")
    o["latest_markets"] = _sql(f"""SELECT {_D}, ticker, title, series, {_r('mid_price')},
  w AS directional_weight FROM markets m WHERE m.date = (SELECT max(date) FROM markets)""", "markets")
    # raw records
    o["latest_partition"] = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id,
  event_type, round(value, 6) + 0.0 AS value FROM events
  WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)"""
    o["source_counts"] = _sql("""SELECT source, count(DISTINCT date) AS n_days,
  count(*) AS n_records FROM docs GROUP BY source""", "docs")
    o["union_records"] = f"""SELECT feed, count(*) AS n, count(url) AS n_url,
  sum(length(body))::BIGINT AS n_chars, min(id) AS first_id FROM (
    SELECT {_id('doc', 'CAST(doc_id AS VARCHAR)')} AS id, 'documents' AS feed, NULL AS url,
      text AS body FROM documents
    UNION ALL SELECT {_id('page', 'url')}, 'pages', url, html FROM pages
    UNION ALL SELECT {_id('talk', "concat_ws('_', conv_id, turn)")}, 'conversations', NULL, text
      FROM conversations) GROUP BY feed"""
    o["dedup_existing"] = _sql(f"""SELECT id, doc_id, source, {_D} FROM (SELECT {_id('doc', 'body')} AS id,
  doc_id, source, date, row_number() OVER (PARTITION BY body ORDER BY doc_id) AS rn FROM docs) d
  WHERE rn = 1 AND id NOT IN (SELECT {_id('doc', 'body')} FROM docs WHERE source = 'src0')""", "docs")
    o["dedup_consecutive"] = """SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER
  (ORDER BY ts DESC, event_id DESC) AS prev FROM events) WHERE event_type IS DISTINCT FROM prev"""
    o["period_select"] = """SELECT period, o_orderkey, o_orderpriority FROM orders JOIN (VALUES
  ('early', TIMESTAMP '1995-03-01', TIMESTAMP '1996-01-01'),
  ('overlap', TIMESTAMP '1995-10-01', TIMESTAMP '1996-06-01'),
  ('late', TIMESTAMP '1999-12-31', TIMESTAMP '2001-02-03')) p(period, a, b)
  ON o_orderdate >= a AND o_orderdate < b
  WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '3-MEDIUM')"""
    # landed payloads
    o["normalize_reddit"] = f"""SELECT {_id('reddit', "'reddit_' || id")} AS id,
  'reddit/r/' || role AS source, 'social' AS source_type, conv_id * 60 + 1704067200 AS epoch,
  md5(role) AS title_md5, md5(body) AS body_md5, 'https://reddit.com/r/' || role AS url,
  turn AS m_score, conv_id AS m_num_comments, {_r('turn / 8.0', 'm_upvote_ratio')},
  role AS m_subreddit, 'top' AS m_sort FROM (SELECT *, concat_ws('_', conv_id, turn) AS id,
    CASE WHEN turn IN (4, 5) OR text IN ('', '[removed]', '[deleted]') THEN role
      ELSE role || chr(10) || chr(10) || text END AS body FROM conversations)
  WHERE length(body) >= 20"""
    stripped = _strip("text")
    o["normalize_reddit_archive"] = f"""SELECT {_id('reddit', "'reddit_' || id")} AS id,
  'reddit/r/' || sub AS source, 'social' AS source_type, conv_id * 60 + 1704067200 AS epoch,
  md5(role) AS title_md5, md5(body) AS body_md5,
  CASE WHEN turn <> 2 THEN 'https://reddit.com/r/' || role END AS url,
  CASE WHEN turn <> 3 THEN turn ELSE 0 END AS m_score, conv_id AS m_num_comments,
  {_r('turn / 8.0', 'm_upvote_ratio')}, sub AS m_subreddit, 'historical' AS m_sort FROM (
    SELECT *, concat_ws('_', conv_id, turn) AS id, CASE WHEN turn = 1 THEN 'unknown' ELSE role END AS sub,
    CASE WHEN turn IN (4, 5) OR {stripped} IN ('', '[removed]', '[deleted]') THEN role
      ELSE role || chr(10) || chr(10) || {stripped} END AS body FROM conversations)
  WHERE length(body) >= 20"""
    o["normalize_gdelt"] = f"""SELECT {_id('gdelt', 'url')} AS id, 'gdelt' AS source,
  'news' AS source_type, CASE WHEN lang <> 'es' THEN epoch({_day('doc_id')}::TIMESTAMP)::BIGINT + 36900
    ELSE epoch(TIMESTAMP '2024-01-31 23:59:59')::BIGINT END AS epoch,
  md5(text) AS title_md5, md5(text) AS body_md5, url, source AS m_query, source AS m_source_country,
  lang AS m_source_lang, {_r('n_chars / 100.0', 'm_tone')}, NULL::DOUBLE AS m_goldstein_scale FROM (
    SELECT *, 'https://' || source || '/' || CAST(doc_id AS VARCHAR) AS url FROM documents)
  WHERE lang <> 'fr' AND text <> ''"""
    o["normalize_fred"] = f"""SELECT 'fred_' || s || '_' || strftime(ts, '%Y%m%d') AS id,
  'fred' AS source, 'macro' AS source_type, epoch(CAST(ts AS DATE)::TIMESTAMP)::BIGINT AS epoch,
  md5(s || ' = ' || shown) AS title_md5, md5(s || ': ' || shown) AS body_md5,
  'https://fred.stlouisfed.org/series/' || s AS url, s AS m_series_id, {_r('v', 'm_value')},
  strftime(ts, '%Y-%m-%d') AS m_date FROM (
    SELECT ts, upper(event_type) AS s, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(value, 2) END AS v,
      CASE WHEN event_type = 'error' THEN '0' ELSE regexp_replace(format('{{:.2f}}', value),
        '\\.?0+$', '') END AS shown FROM events WHERE event_type NOT IN ('view', 'signup'))"""
    o["normalize_edgar"] = f"""SELECT {_id('edgar', "'edgar_' || o_orderstatus || '_' || num")} AS id,
  'sec_edgar' AS source, 'filing' AS source_type, epoch(o_orderdate)::BIGINT AS epoch,
  md5(title) AS title_md5, md5(title) AS body_md5,
  'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&filenum=' || num AS url,
  o_orderstatus AS m_form_type, ent AS m_entity_name, per AS m_period_of_report,
  o_orderpriority AS m_display_names FROM (SELECT *,
    o_orderstatus || ' ' || coalesce(per, '') || ' filing by ' || ent AS title FROM (SELECT *,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '0' END AS num,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS ent,
      CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS per FROM orders))"""
    words = " OR ".join(f"contains(lower(url || ' ' || html), '{w}')" for w in B.EDIT_WORDS)
    o["normalize_wikipedia"] = f"""SELECT {_id('wiki', "'wiki_' || url || '_' || html")} AS id,
  'wikipedia' AS source, 'event' AS source_type, page_id + 1704067200 AS epoch,
  md5(url) AS title_md5, md5(url || ': ' || html) AS body_md5,
  'https://en.wikipedia.org/wiki/' || replace(url, ' ', '_') AS url,
  'en.wikipedia.org' AS m_server, CASE WHEN page_id % 3 <> 0 THEN length(html)
    - CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END END AS m_edit_delta, 'ed' AS m_user
  FROM pages WHERE page_id % 11 <> 0 AND page_id % 4 <> 0 AND page_id % 7 <> 0 AND ({words})"""
    o["stream_changes"] = o["normalize_wikipedia"]
    # macro series and regimes
    o["macro_last_write"] = _sql(f"SELECT {_D}, {_r('value')} FROM all_points", "all_points")
    o["vix_interpolated"] = _sql(f"SELECT {_D}, {_r('value')} FROM vix", "vix")
    o["nearest_join"] = _sql(f"""SELECT CAST(d.date AS VARCHAR) AS date, {_r('p.value', 'value')},
  CAST(p.date AS VARCHAR) AS seen FROM event_days d JOIN points p ON p.date = (SELECT date FROM points q
    ORDER BY abs(q.date - d.date), q.date DESC LIMIT 1)""", "event_days", "points")
    o["regime_labels"] = _sql(f"SELECT {_D}, {_r('vix')}, regime FROM ("
                              + _regimes("event_days", "vix") + ")", "event_days", "vix")
    o["macro_pivot"] = _sql(f"SELECT {_D}, " + ", ".join(_r(
        f"last(value ORDER BY ts, event_id) FILTER (event_type = '{s}')", s)
        for s in B.SERIES) + " FROM writes w GROUP BY w.date", "writes")
    # panel
    names = [("cross_composite", 1), ("cross_positive", 1), ("cross_negative", 1),
             ("cross_count", 0), ("mean_goldstein", 1), ("std_goldstein", 1), ("mean_tone", 1),
             ("conflict_events", 0), ("cooperation_events", 0), ("total_events", 0),
             ("conflict_ratio", 1), ("geopolitical_risk_score", 1), ("kalshi_regime_scalar", 1),
             ("kalshi_n_markets", 0), ("kalshi_n_weighted_markets", 0),
             ("kalshi_total_open_interest", 1), *((x, 0) for x in _LABELS)]
    cells = ", ".join(_r(f"coalesce({c}, 0)", c) if real else f"coalesce({c}, 0) AS {c}"
                      for c, real in names)
    o["feature_matrix"] = _sql(
        f"SELECT {_D}, {cells} FROM sent FULL JOIN geo USING (date) "
        "FULL JOIN market_days USING (date) FULL JOIN topic_days USING (date)",
        "sent", "geo", "market_days", "topic_days")
    o["feature_flags"] = _sql(f"SELECT {_D}, n_orders, " + ", ".join(_r(c) for c in (
        "max_price", "min_price", "std_price")) + ", n_lines, " + ", ".join(_r(c) for c in (
            "mean_discount", "quantity")) + ", part0_missing, part1_missing FROM panel", "panel")
    o["select_features"] = _sql(f"""SELECT {_D}, {_r('coalesce(mean_tone, 0)', 'mean_tone')},
  0.0::DOUBLE AS absent, {_r('coalesce(std_goldstein, 0)', 'std_goldstein')},
  total_events::DOUBLE AS total_events FROM geo""", "geo")
    o["composite_signal"] = _sql(
        f"SELECT {_D}, {_r('cross_composite * 0.6 - geopolitical_risk_score * 0.4', 'signal')} "
        "FROM sent JOIN geo USING (date)", "sent", "geo")
    # prices and alignment
    o["prices_long"] = """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
  o_orderpriority AS ticker, round(max(o_totalprice), 6) + 0.0 AS close FROM orders
  GROUP BY CAST(o_orderdate AS DATE), o_orderpriority"""
    fwd = ", ".join(_r(f"fwd_{h}d") for h in K.HORIZONS)
    o["forward_returns"] = _sql(f"SELECT {_D}, ticker, {_r('close')}, {fwd} FROM returns", "returns")
    o["period_returns"] = _sql(f"""SELECT {_D}, ticker, {_r('close')},
  {_r('close / lag(close) OVER s - 1.0', 'ret')},
  {_r('coalesce(close - lag(close) OVER s, 0.0)', 'diff')} FROM prices p
  WINDOW s AS (PARTITION BY ticker ORDER BY p.date)""", "prices")
    o["series_tail"] = _sql(f"""SELECT {_D}, ticker, {_r('close')} FROM (SELECT *, row_number() OVER
  (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) WHERE rn <= 15""", "prices")
    o["ffill_align"] = _sql(f"SELECT {_D}, ticker, {_r('close')}, {fwd}, regime, " + ", ".join(_r(c) for c in (
        "risk_on_prob", "risk_off_prob", "transition_prob")) + " FROM aligned", "aligned")
    o["asof_align"] = _sql(f"""SELECT CAST(p.date AS VARCHAR) AS date, p.ticker, {_r('p.close', 'close')},
  s.regime, {_r('s.risk_on_prob', 'risk_on_prob')} FROM prices p ASOF LEFT JOIN (
    SELECT date - 1 AS date, regime, risk_on_prob FROM gap_signals) s ON s.date <= p.date""",
                           "prices", "gap_signals")
    # validation
    o["ic_summary"] = _sql(f"""SELECT f.ticker, f.horizon, {_r('f.rho', 'ic')},
  {_r('CASE WHEN abs(f.rho) >= 1 THEN 0.0 ELSE p END', 'ic_pvalue')},
  {_r('CASE WHEN s > 0 THEN m / s * sqrt(252) END', 'ir')}, {_r('hit_rate')}, f.n AS n_obs,
  CASE WHEN round(f.rho, 6) > 0.05 THEN 'positive' WHEN round(f.rho, 6) < -0.05 THEN 'negative'
    ELSE 'neutral' END AS ic_class
  FROM full_ic f LEFT JOIN p_value USING (ticker, horizon) LEFT JOIN ir USING (ticker, horizon)
  JOIN hit USING (ticker, horizon) WHERE f.n >= {K.MIN_OBSERVATIONS}""",
                           "full_ic", "p_value", "ir", "hit")
    o["rolling_ic"] = _sql(f"SELECT {_D}, ticker, {_r('rho', 'rolling_ic')} FROM rho_b", "rho_b")
    o["rolling_ic_wide"] = _sql(f"SELECT {_D}, " + ", ".join(
        _r(f"max(rho) FILTER (ticker = '{t}')", f'"{t}"') for t in B.MAPPING)
        + " FROM rho_b r GROUP BY r.date", "rho_b")
    o["rolling_tickers"] = _sql("SELECT DISTINCT ticker FROM rho_b", "rho_b")
    # back-test
    o["backtest_positions"] = _sql(
        f"SELECT strategy_id, {_D}, bar, {_r('signal')}, position FROM held", "held")
    o["backtest_equity"] = _sql(f"""SELECT strategy_id, {_D}, {_r('period_return')}, {_r('equity')},
  {_r('peak')}, {_r('(equity - peak) / peak', 'drawdown')} FROM curve""", "curve")
    o["backtest_lagged"] = _sql(
        f"SELECT strategy_id, {_D}, {_r('period_return')}, {_r('equity')} FROM curve_lag",
        "curve_lag")
    o["backtest_trades"] = _sql(f"""SELECT strategy_id, trade_id::BIGINT AS trade_id,
  CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date,
  {_r('entry_price')}, {_r('exit_price')}, {_r('trade_return')} FROM trades""", "trades")
    o["backtest_metrics"] = _sql(f"""SELECT strategy_id, signal_source, lookback_days, n_bars,
  {_r('total_return')}, {_r('ann', 'annualized_return')}, {_ratio('vol', 'sharpe_ratio')},
  {_ratio('down', 'sortino_ratio')}, {_r('max_drawdown')},
  {_ratio('abs(max_drawdown)', 'calmar_ratio')}, {_r('win_rate')}, n_trades FROM metrics""", "metrics")
    ratio = "coalesce(CASE WHEN {0} > 0 THEN ann / {0} END, 0.0)".format
    exact = {"annualized_return": "ann", "sharpe_ratio": ratio("vol"), "sortino_ratio": ratio("down"),
             "calmar_ratio": ratio("abs(max_drawdown)")}
    o["backtest_reported"] = _sql(
        "SELECT strategy_id, signal_source, lookback_days, n_bars, n_trades, " + ", ".join(
            f"round({exact.get(c, c)}, {d}) + 0.0 AS {c}" for c, d in SHOWN.items())
        + " FROM metrics", "metrics")
    o["backtest_summary"] = _sql("""SELECT strategy_id, n_trades, printf('%s signal backtest over '
  || '%d days. Strategy produced %s annualized returns of %.1f%% with Sharpe %.2f, max drawdown '
  || '%.1f%%, and %d trades at %.0f%% win rate.', upper(signal_source[1]) || signal_source[2:],
  lookback_days, CASE WHEN ann > 0 THEN 'positive' ELSE 'negative' END, ann * 100,
  coalesce(CASE WHEN vol > 0 THEN ann / vol END, 0.0), max_drawdown * 100, n_trades,
  win_rate * 100) AS summary FROM metrics""", "metrics")
    o["backtest_rejected"] = _sql("""SELECT strategy_id,
  'fewer than 30 bars with signal and price' AS reason FROM params
  WHERE signal_source = 'sentiment'""", "params")
    # tables and streaming
    o["upsert_daily"] = f"""SELECT CAST(a.date AS VARCHAR) AS date, coalesce(e.n, a.n) AS n,
  round(coalesce(e.top, a.top), 6) + 0.0 AS top FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n,
    max(value) AS top FROM events GROUP BY 1) a LEFT JOIN (SELECT CAST(ts AS DATE) AS date,
    count(*) AS n, max(value) AS top FROM events WHERE event_type = 'error' AND day(ts) > 20
    GROUP BY 1) e ON a.date = e.date"""
    o["publish_signals"] = _sql(f"""SELECT {_D}, regime,
  CASE WHEN year(s.date) >= 2000 THEN 1.0 ELSE round(confidence, 6) END::DOUBLE AS confidence, """
        + ", ".join(_r(c) for c in ("risk_on_prob", "risk_off_prob", "transition_prob"))
        + " FROM (SELECT * FROM signals ORDER BY date DESC LIMIT 90) s", "signals")
    total = "(risk_on_prob + risk_off_prob * 2 + transition_prob * 0.5::DOUBLE)"
    share = "{} / CASE WHEN " + total + " = 0 THEN 1.0 ELSE " + total + " END"
    o["renormalised_signals"] = _sql(f"""SELECT {_D}, strftime(s.date, '%b %-d') AS shown,
  replace(regime, '_', ' ') AS regime, {_r(share.format('risk_on_prob'), 'risk_on')},
  {_r(share.format('risk_off_prob * 2'), 'risk_off')},
  {_r(share.format('transition_prob * 0.5::DOUBLE'), 'transition')} FROM signals s""", "signals")
    o["raw_roundtrip"] = _sql(f"""SELECT source AS feed, CAST(d.date AS VARCHAR) AS ingest_date,
  count(*) AS n, sum(CASE WHEN d.date = DATE '2024-01-05' THEN 8 ELSE length(body) END)::BIGINT AS n_chars
  FROM docs d GROUP BY source, d.date""", "docs")
    o["raw_jsonl"] = _sql("""SELECT source AS feed, CAST(d.date AS VARCHAR) AS ingest_date,
  CAST(source_type IN ('es', 'de') AS BIGINT) AS bad, count(*) AS rows,
  sum(CASE WHEN source_type IN ('es', 'de') THEN 0 ELSE length(body) END)::BIGINT AS n_chars
  FROM docs d GROUP BY source, d.date, 3""", "docs")
    o["stream_daily"] = o["geo_daily"]
    o["stream_recomputed"] = o["stream_merged"] = o["geo_daily"]
    o["stream_markets"] = o["market_scalar"]
    o["stream_sentiment"] = o["sentiment_daily"]
    o["raw_by_day"] = _sql("""SELECT source AS feed, CAST(d.date AS VARCHAR) AS ingest_date,
  count(*) AS n, sum(length(body))::BIGINT AS n_chars FROM docs d
  WHERE d.date IN (DATE '2024-01-05', DATE '2024-01-20') GROUP BY source, d.date""", "docs")
    o["ingest_all"] = " UNION ALL ".join(
        f"SELECT '{feed}' AS feed, '2024-02-01' AS ingest_date, count({what}) AS n, "
        f"min(id) AS first_id, max(id) AS last_id FROM ({o['normalize_' + feed]}) x"
        for feed, what in (("reddit", "*"), ("gdelt", "DISTINCT id"), ("fred", "*"),
                           ("edgar", "*")))
    o["stream_dedup"] = "SELECT DISTINCT user_id AS id FROM events"
    o["stream_first"] = """WITH e AS (SELECT *, (event_id + 1) % 3 AS part,
  row_number() OVER (PARTITION BY user_id ORDER BY (event_id + 1) % 3, ts, event_id) AS i FROM events),
f AS (SELECT * FROM e WHERE i = 1)
SELECT f.user_id, f.event_id, epoch_us(f.ts) AS micros, f.event_type, round(f.value, 6) + 0.0 AS value, f.props,
  count(*) FILTER (e.i > 1 AND (e.part = f.part OR e.ts >= f.ts)) AS n_repeat,
  count(*) FILTER (e.part > f.part AND e.ts < f.ts) AS n_late
FROM f JOIN e USING (user_id) GROUP BY ALL"""
    # model
    o["training_labels"] = _sql(
        f"SELECT {_D}, n_orders, {_r('quantity')}, {_r('vix')}, regime FROM ("
        + _regimes("panel", "long_series") + ")", "panel", "long_series")
    o["ts_split"] = _sql("""SELECT CAST(date AS VARCHAR) AS date, fold,
  CASE WHEN i < start THEN 'train' ELSE 'test' END AS part FROM (SELECT date, i, fold,
    n - (3 - fold) * (n // 4) AS start, n // 4 AS size FROM (SELECT date, i, n,
      unnest(range(0, 3)) AS fold FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i,
        count(*) OVER () AS n FROM shares3))) WHERE i < start + size""", "shares3")
    judged = """SELECT lang AS fold, CAST(quality AS VARCHAR) AS label, CASE WHEN n_chars > 2000 THEN '2'
  WHEN n_chars > 400 THEN '1' ELSE '0' END AS prediction FROM labels JOIN documents USING (doc_id)"""
    o["confusion"] = f"""SELECT fold, label, count(*) FILTER (prediction = '0') AS "0",
  count(*) FILTER (prediction = '1') AS "1", count(*) FILTER (prediction = '2') AS "2"
  FROM ({judged}) GROUP BY fold, label"""
    o["class_report"] = f"""WITH j AS ({judged}), c AS (SELECT fold, label AS class FROM j UNION
  SELECT fold, prediction FROM j), m AS (SELECT c.fold, c.class,
    count(*) FILTER (label = class AND prediction = class) AS tp,
    count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS predicted,
    count(*) FILTER (label = prediction) AS hits, count(*) AS n FROM c JOIN j USING (fold)
    GROUP BY c.fold, c.class), q AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS p,
    coalesce(tp / nullif(support, 0), 0.0) AS r FROM m)
  SELECT fold, class, {_r('p', 'precision')}, {_r('r', 'recall')},
  {_r('coalesce(2.0 * p * r / nullif(p + r, 0), 0.0)', 'f1')}, support, {_r('hits / n', 'accuracy')}
  FROM q"""
    quarter = """SELECT date, ['risk_on', 'transition', 'risk_off'][quarter(date) % 3 + 1] AS regime
  FROM shares3"""
    o["predict_known"] = _sql(f"SELECT {_D}, regime FROM ({quarter}) q", "shares3")
    o["train_known"] = _sql(f"""SELECT fold, regime AS class, 1.0::DOUBLE AS precision,
  1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, count(*) AS support, 1.0::DOUBLE AS accuracy FROM (
    SELECT regime, unnest(range(0, 2)) AS fold, row_number() OVER (ORDER BY date) - 1 AS i,
      count(*) OVER () AS n FROM ({quarter}) q)
  WHERE i >= n - (2 - fold) * (n // 3) AND i < n - (1 - fold) * (n // 3) GROUP BY fold, regime""",
                            "shares3")
    o["latest_known"] = _sql(f"""SELECT {_D}, CASE WHEN known THEN regime ELSE 'unknown' END AS regime,
  source, n_days, n_records FROM (SELECT * FROM ({quarter}) q ORDER BY date DESC LIMIT 1) l,
  (SELECT unnest([true, false]) AS known) k, (SELECT source, count(DISTINCT date) AS n_days,
    count(*) AS n_records FROM docs GROUP BY source) c""", "shares3", "docs")
    # one tree: quarter 3 is risk_on, else the day of the month decides; an unknown split counts both
    # sides by their days
    shap = """WITH d AS (SELECT date, (quarter(date) = 3)::INT AS q, (day(date) % 4 = 0)::INT AS b FROM shares3),
  s AS (SELECT avg(q) AS p, avg(b) FILTER (q = 0) AS r FROM d),
  c AS (SELECT d.*, s.*, unnest(['risk_on', 'risk_off', 'transition']) AS class FROM d, s),
  v AS (SELECT *, (class = 'risk_on')::INT AS e1, (class = 'transition')::INT AS e2,
    (class = 'risk_off')::INT AS e3 FROM c),
  w AS (SELECT date, class, e1 * p + (1 - p) * (e2 * r + e3 * (1 - r)) AS base,
    e1 * (q - p) + (p - q) * (e2 * (r + b) + e3 * (2 - r - b)) / 2 AS level,
    (e2 - e3) * (b - r) * (2 - p - q) / 2 AS band FROM v),
  x AS (SELECT date, class, base, unnest(['level', 'band', 'n_orders']) AS feature,
    unnest([level, band, 0.0]) AS phi FROM w)"""
    o["shapley_known"] = _sql(
        f"SELECT {_D}, feature, class, {_r('phi')}, {_r('base')} FROM ({shap} SELECT * FROM x) x", "shares3")
    o["attribution_known"] = _sql(f"""SELECT feature, {_r('avg(abs(phi))', 'mean_shap')}
  FROM ({shap} SELECT * FROM x WHERE date IN (SELECT date FROM d ORDER BY date DESC LIMIT 50))
  GROUP BY feature ORDER BY avg(abs(phi)) DESC, feature LIMIT 10""", "shares3")
    o["latest_signal"] = _sql(f"""SELECT s.*, source, n_days, n_records FROM (
  SELECT {_D}, regime, {_r('confidence')} FROM signals ORDER BY signals.date DESC LIMIT 1) s,
  (SELECT source, count(DISTINCT date) AS n_days, count(*) AS n_records FROM docs GROUP BY source)""",
                              "signals", "docs")
    return o

