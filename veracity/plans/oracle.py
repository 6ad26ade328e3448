"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Every statement reads the driver's pre-registered views and must produce
the same column names, types and values as the Spark query of that name.
Shared CTEs are composed from the fragments below.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Shared fragments

FACTS = """
lines AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT n.n_nationkey, n.n_name,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(quarter(o.o_orderdate) AS INTEGER) AS quarter,
         count(*) AS orders, count(l.l_orderkey) AS seen, sum(l.lines) AS lines
  FROM orders o
  LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
own AS (
  SELECT r_name AS owner, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SENDER = """
sender_periodic AS (
  SELECT n_name AS entity, year,
         CASE WHEN n_nationkey % 2 = 1 THEN 'Q' ELSE 'H' END AS freq,
         CASE WHEN n_nationkey % 2 = 1 THEN quarter ELSE (quarter - 1) // 2 + 1 END AS part,
         CAST(sum(orders) AS DOUBLE) AS reports, CAST(sum(lines) AS DOUBLE) AS pieces
  FROM facts GROUP BY ALL
),
sender_annual AS (
  SELECT entity, year, sum(reports) AS reports, sum(pieces) AS pieces
  FROM sender_periodic
  GROUP BY entity, year
  HAVING min(CASE freq WHEN 'Q' THEN (part - 1) * 3 + 1 WHEN 'H' THEN (part - 1) * 6 + 1 ELSE 1 END) = 1
     AND max(CASE freq WHEN 'Q' THEN part * 3 WHEN 'H' THEN part * 6 ELSE 12 END) = 12
),
sent AS (
  SELECT coalesce(own.owner, s.entity) AS entity, s.year,
         sum(s.pieces) AS pieces, sum(s.reports) AS reports
  FROM sender_annual s LEFT JOIN own ON s.entity = own.member
  GROUP BY ALL
),
got AS (
  SELECT coalesce(own.owner, f.n_name) AS entity, f.year, CAST(sum(f.seen) AS DOUBLE) AS received
  FROM facts f LEFT JOIN own ON f.n_name = own.member
  GROUP BY ALL
),
totals AS (SELECT year, sum(seen)::BIGINT AS esp, sum(orders)::BIGINT AS total FROM facts GROUP BY year),
spine AS (
  SELECT e.entity, CAST(y.year AS INTEGER) AS year
  FROM (SELECT DISTINCT entity FROM got) e,
       (SELECT unnest(range((SELECT min(year) FROM got), (SELECT max(year) FROM got) + 1)) AS year) y
),
audit AS (
  SELECT sp.entity, sp.year, s.pieces,
         s.pieces / coalesce(s.reports, g.received) AS pi,
         s.reports,
         (g.received - s.reports) / ((g.received + s.reports) / 2.0) * 100.0 AS delta_pct,
         g.received,
         coalesce(g.received, s.reports) / t.esp * 100.0 AS esp_pct,
         t.esp,
         coalesce(g.received, s.reports) / t.total * 100.0 AS total_pct,
         t.total,
         CAST(t.esp AS DOUBLE) / t.total * 100.0 AS esp_total_pct
  FROM spine sp
  LEFT JOIN sent s ON sp.entity = s.entity AND sp.year = s.year
  LEFT JOIN got g ON sp.entity = g.entity AND sp.year = g.year
  LEFT JOIN totals t ON sp.year = t.year
)"""


def with_(*fragments: str) -> str:
    return "WITH " + ",".join(f.strip("\n") for f in fragments) + "\n"


AUDIT = with_(FACTS, SENDER)

ORACLE: dict[str, str] = {
    "audit_by_region_year": AUDIT + "SELECT * FROM audit",
}

PAIRS = """
pairs AS (
  SELECT entity || '-' || CAST(year AS VARCHAR) AS id, entity AS topic, year,
         'ServiceProvider' AS observer, CAST(reports AS BIGINT) AS count
  FROM audit WHERE reports IS NOT NULL AND received IS NOT NULL
  UNION ALL
  SELECT entity || '-' || CAST(year AS VARCHAR), entity, year, 'Receiver', CAST(received AS BIGINT)
  FROM audit WHERE reports IS NOT NULL AND received IS NOT NULL
),
diffs AS (
  SELECT id, (a + b) / 2.0 AS mean, b - a AS diff, (b - a) / ((a + b) / 2.0) * 100.0 AS pct_diff
  FROM (SELECT id,
               CAST(max(CASE WHEN observer = 'ServiceProvider' THEN count END) AS DOUBLE) AS a,
               CAST(max(CASE WHEN observer = 'Receiver' THEN count END) AS DOUBLE) AS b
        FROM pairs GROUP BY id)
)"""

CONTINGENCY = """
contingency AS (
  SELECT entity = 'AMERICA' AS in_group,
         count(*) FILTER (WHERE abs(delta_pct) > 1.5) AS outlier,
         count(*) FILTER (WHERE NOT abs(delta_pct) > 1.5) AS close
  FROM audit WHERE delta_pct IS NOT NULL GROUP BY 1
)"""

STATS = with_(FACTS, SENDER, PAIRS, CONTINGENCY)

RECEIVER_ROLLUP = """
rolled AS (
  SELECT coalesce(own.owner, f.n_name) AS entity, f.year, CAST(sum(f.seen) AS DOUBLE) AS value
  FROM facts f LEFT JOIN own ON f.n_name = own.member GROUP BY ALL
),
members AS (
  SELECT f.n_name AS entity, f.year, CAST(sum(f.seen) AS DOUBLE) AS value
  FROM facts f JOIN own ON f.n_name = own.member GROUP BY ALL
),
rolled_ex AS (
  SELECT coalesce(o.owner, f.n_name) AS entity, f.year, CAST(sum(f.seen) AS DOUBLE) AS value
  FROM facts f LEFT JOIN (SELECT * FROM own WHERE owner <> 'ASIA') o ON f.n_name = o.member GROUP BY ALL
)"""

SENDER_LONG = """
sender_rows AS (
  SELECT entity, year, freq, part, 'reports' AS metric, reports AS value FROM sender_periodic
  UNION ALL
  SELECT entity, year, freq, part, 'pieces', pieces FROM sender_periodic
),
knocked AS (
  SELECT entity, year, freq, part, metric,
         CASE WHEN freq = 'Q' AND year = 1997 AND part = 2 AND metric = 'pieces' THEN NULL ELSE value END AS value
  FROM sender_rows
)"""

ORACLE.update({
    "audit_comparable_pairs": STATS + "SELECT * FROM pairs",
    "bland_altman": STATS + """
SELECT count(*) AS n_pairs, round(avg(pct_diff), 9) AS mean_pct_diff, round(max(abs(pct_diff)), 9) AS ymax,
       min(mean) AS xmin, max(mean) AS xmax FROM diffs""",
    "sign_tally": STATS + "SELECT CAST(sign(pct_diff) AS INTEGER) AS sign, count(*) AS n FROM diffs GROUP BY 1",
    "sign_test_p": STATS + """
SELECT c.positive, c.n,
       round(CASE WHEN c.positive <= 0 THEN 1.0 WHEN c.positive > c.n THEN 0.0 ELSE
         (SELECT least(sum(exp(lgamma(c.n + 1) - lgamma(i + 1) - lgamma(c.n - i + 1) + c.n * ln(0.5))), 1.0)
          FROM range(c.positive, c.n + 1) r(i)) END, 12) AS p_value
FROM (SELECT count(*) FILTER (WHERE pct_diff > 0) AS positive,
             count(*) FILTER (WHERE pct_diff <> 0) AS n FROM diffs) c""",
    "severity_bins": STATS + """
SELECT CASE WHEN abs(delta_pct) <= 5 THEN 0 WHEN abs(delta_pct) <= 30 THEN 1
            WHEN abs(delta_pct) <= 100 THEN 2 ELSE 3 END AS severity, count(*) AS n
FROM audit WHERE delta_pct IS NOT NULL GROUP BY 1""",
    "outlier_contingency": STATS + "SELECT * FROM contingency",
    "outlier_fisher_p": STATS + """
SELECT t.a, t.b, t.c, t.d,
  round(CASE WHEN t.a > least(t.a + t.c, t.a + t.b) THEN 0.0 ELSE
    (SELECT least(sum(exp(
        lgamma(t.a + t.c + 1) - lgamma(x + 1) - lgamma(t.a + t.c - x + 1)
      + lgamma(t.b + t.d + 1) - lgamma(t.a + t.b - x + 1) - lgamma(t.b + t.d - t.a - t.b + x + 1)
      - lgamma(t.a + t.b + t.c + t.d + 1) + lgamma(t.a + t.b + 1) + lgamma(t.c + t.d + 1))), 1.0)
     FROM range(t.a, least(t.a + t.c, t.a + t.b) + 1) r(x)) END, 12) AS p_value
FROM (SELECT coalesce(sum(outlier) FILTER (WHERE in_group), 0)::BIGINT AS a,
             coalesce(sum(close) FILTER (WHERE in_group), 0)::BIGINT AS b,
             coalesce(sum(outlier) FILTER (WHERE NOT in_group), 0)::BIGINT AS c,
             coalesce(sum(close) FILTER (WHERE NOT in_group), 0)::BIGINT AS d FROM contingency) t""",
    "annualize_rows": with_(FACTS, SENDER) + """
SELECT entity, 'sender' AS observer, CAST(year AS VARCHAR) AS label, year, 'reports' AS metric, reports AS value
FROM sender_annual
UNION ALL
SELECT entity, 'sender', CAST(year AS VARCHAR), year, 'pieces', pieces FROM sender_annual""",
    "annualize_strict": with_(FACTS, SENDER, SENDER_LONG) + """
SELECT entity, year, metric,
       CASE WHEN bit_or(CASE WHEN value IS NOT NULL THEN
              CASE freq WHEN 'Q' THEN 1 << (part - 1) WHEN 'H' THEN 3 << ((part - 1) * 2) ELSE 15 END
            END) = 15 THEN sum(value) END AS value
FROM knocked GROUP BY entity, year, metric""",
    "rollup_drop_members": with_(FACTS, RECEIVER_ROLLUP) + "SELECT * FROM rolled",
    "rollup_keep_members": with_(FACTS, RECEIVER_ROLLUP) + "SELECT * FROM rolled UNION ALL SELECT * FROM members",
    "rollup_exclude_owner": with_(FACTS, RECEIVER_ROLLUP) + "SELECT * FROM rolled_ex",
    "wide_receiver_counts": with_(FACTS, RECEIVER_ROLLUP) + """
SELECT year,
  sum(value) FILTER (WHERE entity = 'AFRICA') AS "AFRICA",
  sum(value) FILTER (WHERE entity = 'AMERICA') AS "AMERICA",
  sum(value) FILTER (WHERE entity = 'ASIA') AS "ASIA",
  sum(value) FILTER (WHERE entity = 'EUROPE') AS "EUROPE",
  sum(value) FILTER (WHERE entity = 'MIDDLE EAST') AS "MIDDLE EAST"
FROM rolled GROUP BY year""",
    "long_receiver_counts": with_(FACTS, RECEIVER_ROLLUP) + """
SELECT entity, 'receiver' AS observer, year, 'reports' AS metric, value FROM rolled""",
})

SNAPSHOTS = """
inc AS (
  SELECT n.n_name AS nation, o.o_orderpriority AS priority, o.o_orderstatus AS status,
         CAST(year(o.o_orderdate) * 4 + quarter(o.o_orderdate) - 1 AS INTEGER) AS period,
         CAST(greatest(year(l.l_shipdate) * 4 + quarter(l.l_shipdate) - 1,
                       year(o.o_orderdate) * 4 + quarter(o.o_orderdate) - 1) AS INTEGER) AS snapshot,
         sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS inc
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
grid AS (
  SELECT nation, priority, status, period, CAST(unnest(range(first, last + 1)) AS INTEGER) AS snapshot
  FROM (SELECT nation, priority, status, period, min(snapshot) AS first FROM inc GROUP BY ALL),
       (SELECT max(snapshot) AS last FROM inc)
),
snaps AS (
  SELECT g.nation, g.priority, g.status, g.period, g.snapshot,
         CAST(sum(i.inc) OVER (PARTITION BY g.nation, g.priority, g.status, g.period ORDER BY g.snapshot
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cents
  FROM grid g LEFT JOIN inc i
    ON g.nation = i.nation AND g.priority = i.priority AND g.status = i.status
   AND g.period = i.period AND g.snapshot = i.snapshot
),
diffs AS (
  SELECT ps AS snapshot, nation, priority, status, period, pv AS value_before, cents AS value_after
  FROM (SELECT *, lag(snapshot) OVER w AS ps, lag(cents) OVER w AS pv FROM snaps
        WINDOW w AS (PARTITION BY nation, priority, status, period ORDER BY snapshot))
  WHERE ps = snapshot - 1 AND pv <> cents
)"""

SNAP = with_(SNAPSHOTS)

ORACLE.update({
    "snapshot_diff": SNAP + "SELECT * FROM diffs",
    "divergence_rate": SNAP + """
SELECT t.snapshot + 1 AS period, coalesce(c.changed, 0) AS changed, t.total,
       coalesce(c.changed, 0) / t.total * 100.0 AS rate_of_divergence
FROM (SELECT snapshot, count(*) AS total FROM snaps GROUP BY snapshot) t
JOIN (SELECT DISTINCT snapshot FROM snaps) n ON n.snapshot = t.snapshot + 1
LEFT JOIN (SELECT snapshot, count(*) AS changed FROM diffs GROUP BY snapshot) c ON c.snapshot = t.snapshot""",
    "divergence_age": SNAP + "SELECT snapshot, period, count(*) AS divergent FROM diffs GROUP BY ALL",
    "divergence_descriptors": SNAP + """
SELECT DISTINCT snapshot, 'priority' AS descriptor, priority AS value FROM diffs
UNION
SELECT DISTINCT snapshot, 'status', status FROM diffs""",
    "quarter_latest_excluded": SNAP + """
SELECT nation, priority, status,
       printf('%04d Q%d', CAST(floor(period / 4) AS INTEGER), CAST(period % 4 + 1 AS INTEGER)) AS period_label,
       period + 1 AS next_period, cents
FROM snaps
WHERE snapshot = 2000 * 4 + 3
  AND period <> (SELECT max(period) FROM snaps WHERE snapshot = 2000 * 4 + 3)""",
})

COUNTRY = """
base AS (
  SELECT n.n_name AS nation, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         count(*) AS reports, count(DISTINCT o.o_custkey) AS population
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
dims AS (
  SELECT n.n_name AS nation, r.r_name AS region, oc.online
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS online FROM customer GROUP BY 1) oc
    ON n.n_nationkey = oc.c_nationkey
),
league AS (
  SELECT n_name AS nation FROM nation
  WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0)
),
pc AS (
  SELECT b.nation, b.year, b.reports,
         CAST(b.reports AS DOUBLE) / sum(CAST(b.reports AS DOUBLE)) OVER (PARTITION BY b.year) * 100.0 AS reports_pct,
         b.population,
         CAST(b.population AS DOUBLE) / sum(CAST(b.population AS DOUBLE)) OVER (PARTITION BY b.year) * 100.0 AS population_pct,
         CAST(b.reports AS DOUBLE) / CAST(b.population AS DOUBLE) AS reports_per_capita,
         d.region, d.online,
         b.nation IN (SELECT nation FROM league) AS league
  FROM base b LEFT JOIN dims d ON b.nation = d.nation
),
with_league AS (
  SELECT nation, year, reports, reports_pct, population, population_pct, reports_per_capita, region, online, league
  FROM pc
  UNION ALL
  SELECT 'LEAGUE', year, CAST(sum(reports) AS BIGINT), sum(reports_pct), CAST(sum(population) AS BIGINT), sum(population_pct),
         CAST(sum(reports) AS DOUBLE) / CAST(sum(population) AS DOUBLE), NULL, NULL, false
  FROM pc WHERE league GROUP BY year
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY reports_per_capita DESC, nation ASC) AS INTEGER) AS rank
  FROM pc
),
ranked_league AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY reports_per_capita DESC, nation ASC) AS INTEGER) AS rank
  FROM with_league
),
status_counts AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS orders
  FROM orders GROUP BY ALL
)"""

CTRY = with_(COUNTRY)

ORACLE.update({
    "per_capita_by_nation_year": CTRY + "SELECT * FROM pc",
    "rank_per_capita": CTRY + "SELECT nation, year, reports_per_capita, rank FROM ranked",
    "topk_per_year": CTRY + "SELECT nation, year, reports_per_capita, rank FROM ranked WHERE rank <= 10",
    "league_summary_row": CTRY + """
SELECT nation, year, reports, round(reports_pct, 9) AS reports_pct, population,
       round(population_pct, 9) AS population_pct, reports_per_capita, region, online, league
FROM with_league""",
    "rank_of_league": CTRY + "SELECT year, rank FROM ranked_league WHERE nation = 'LEAGUE'",
    "members_in_topk": CTRY + """
SELECT year, count(*) FILTER (WHERE league) AS members FROM ranked_league WHERE rank <= 10 GROUP BY year""",
    "survey_total_row": CTRY + """
SELECT year, status, orders FROM status_counts
UNION ALL SELECT year, 'Total', sum(orders)::BIGINT FROM status_counts GROUP BY year""",
    "region_rollup_ratio": CTRY + """
SELECT year, region, 'WORLD' AS top, sum(reports)::BIGINT AS reports, sum(population)::BIGINT AS population,
       CAST(sum(reports) AS DOUBLE) / CAST(sum(population) AS DOUBLE) AS reports_per_capita
FROM pc GROUP BY year, region""",
    "facts_without_denominator": CTRY + """
SELECT year, sum(reports)::BIGINT AS reports, count(DISTINCT nation) AS keys_without
FROM base WHERE nation NOT IN (
  SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000.0))
GROUP BY year""",
    "share_of_total": CTRY + """
SELECT year, status, orders, sum(orders) OVER (PARTITION BY year)::BIGINT AS year_total,
       CAST(orders AS DOUBLE) / sum(CAST(orders AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS share
FROM status_counts""",
    "running_share": CTRY + """
SELECT nation, year, reports,
       CAST(sum(reports) OVER (PARTITION BY year ORDER BY reports DESC, nation ASC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
       / CAST(sum(reports) OVER (PARTITION BY year) AS DOUBLE) * 100.0 AS running_share
FROM base""",
    "top_share_others": CTRY + """
, shares AS (SELECT year, nation,
                    CAST(reports AS DOUBLE) / sum(CAST(reports AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS share
             FROM base),
kept AS (SELECT * FROM shares WHERE share > 4.2)
SELECT year, nation, round(share, 9) AS share FROM kept
UNION ALL SELECT year, 'Others', round(100.0 - sum(share), 9) FROM kept GROUP BY year""",
})

SERIES = """
monthly AS (
  SELECT n.n_name AS nation, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month, count(*) AS orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
mx AS (SELECT nation, year, month, (year - 1995) * 12 + month - 1 AS x, orders FROM monthly),
quarterly AS (
  SELECT nation, CAST(year * 4 + floor((month - 1) / 3) AS INTEGER) AS qidx, sum(orders)::BIGINT AS orders
  FROM monthly GROUP BY ALL
),
yearly AS (SELECT nation, year, sum(orders)::BIGINT AS orders FROM monthly GROUP BY ALL),
yearly_prev AS (
  SELECT *, first(orders) OVER (PARTITION BY nation ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev
  FROM yearly
),
lin AS (
  SELECT nation, regr_slope(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)) AS slope,
         regr_intercept(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)) AS intercept,
         CAST(regr_count(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)) AS BIGINT) AS n
  FROM mx GROUP BY nation
),
ex AS (
  SELECT nation, regr_slope(ln(orders), CAST(x AS DOUBLE)) AS rate,
         regr_intercept(ln(orders), CAST(x AS DOUBLE)) AS log_scale
  FROM mx WHERE orders > 0 GROUP BY nation
),
wsums AS (
  SELECT nation, sum(CAST(orders AS DOUBLE)) AS sw, sum(orders * CAST(x AS DOUBLE)) AS swx,
         sum(orders * ln(orders)) AS swz, sum(orders * CAST(x AS DOUBLE) * x) AS swxx,
         sum(orders * CAST(x AS DOUBLE) * ln(orders)) AS swxz
  FROM mx WHERE orders > 0 GROUP BY nation
),
wex AS (
  SELECT nation, (sw * swxz - swx * swz) / (sw * swxx - swx * swx) AS rate, sw, swx, swz FROM wsums
)"""

TR = with_(SERIES)

STATUS = with_(COUNTRY) + """
, shares AS (
  SELECT year, status, orders,
         CAST(orders AS DOUBLE) / sum(CAST(orders AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS share
  FROM status_counts
)"""

ORACLE.update({
    "yoy_change": TR + """
SELECT nation, qidx, orders, (CAST(orders AS DOUBLE) - prev) / CAST(prev AS DOUBLE) * 100.0 AS yoy_pct
FROM (SELECT *, first(orders) OVER (PARTITION BY nation ORDER BY qidx
                                    RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS prev FROM quarterly)""",
    "growth_fixed_base": TR + """
SELECT nation, year, orders, CAST(orders AS DOUBLE) - prev AS diff,
       CAST(orders AS DOUBLE) / max(CASE WHEN year = 1995 THEN CAST(orders AS DOUBLE) END)
         OVER (PARTITION BY nation) * 100.0 AS pct_of_base
FROM yearly_prev""",
    "growth_zscore": TR + """
, g AS (SELECT nation, year, (CAST(orders AS DOUBLE) - prev) / CAST(prev AS DOUBLE) * 100.0 AS growth
        FROM yearly_prev WHERE prev IS NOT NULL)
SELECT nation, year, round(growth, 9) AS growth,
       round((growth - avg(growth) OVER (PARTITION BY nation)) / stddev_samp(growth) OVER (PARTITION BY nation), 9) AS z
FROM g""",
    "linear_fit": TR + "SELECT nation, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n FROM lin",
    "piecewise_fit": TR + """
SELECT nation, CASE WHEN x < 36 THEN 'before' ELSE 'after' END AS segment,
       round(regr_slope(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)), 6) AS slope,
       round(regr_intercept(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)), 6) AS intercept,
       CAST(regr_count(CAST(orders AS DOUBLE), CAST(x AS DOUBLE)) AS BIGINT) AS n
FROM mx GROUP BY ALL""",
    "exp_fit": TR + "SELECT nation, round(rate, 6) AS rate, round(log_scale, 6) AS log_scale FROM ex",
    "weighted_exp_fit": TR + """
SELECT nation, round(rate, 6) AS rate, round((swz - rate * swx) / sw, 6) AS log_scale FROM wex""",
    "fit_mse": TR + """
, fitted AS (
  SELECT m.nation, m.orders, l.intercept + l.slope * m.x AS linear, exp(e.log_scale + e.rate * m.x) AS exponential
  FROM mx m JOIN lin l ON m.nation = l.nation JOIN ex e ON m.nation = e.nation
)
SELECT nation, 'linear' AS model, round(avg(pow(CAST(orders AS DOUBLE) - linear, 2)), 6) AS mse FROM fitted GROUP BY nation
UNION ALL
SELECT nation, 'exponential', round(avg(pow(CAST(orders AS DOUBLE) - exponential, 2)), 6) FROM fitted GROUP BY nation""",
    "describe_growth": """
SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, max(l_extendedprice) AS max
FROM lineitem GROUP BY l_returnflag""",
    "histogram_10": """
SELECT CAST(CASE WHEN b.hi = b.lo THEN 1 ELSE
         least(greatest(floor((l_extendedprice - b.lo) / (b.hi - b.lo) * 10) + 1, 1), 10) END AS INTEGER) AS bin,
       count(*) AS n
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) b GROUP BY 1""",
    "cut_bins": """
SELECT CAST(CASE WHEN b.hi = b.lo THEN 1 ELSE
         least(greatest(ceil((l_quantity - b.lo) / (b.hi - b.lo) * 5), 1), 5) END AS INTEGER) AS bin,
       count(*) AS n
FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) b GROUP BY 1""",
    "qcut_bins": """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= e.q[2] THEN 1 WHEN o_totalprice <= e.q[3] THEN 2
            WHEN o_totalprice <= e.q[4] THEN 3 WHEN o_totalprice <= e.q[5] THEN 4 END AS bin, count(*) AS n
FROM orders, e GROUP BY 1""",
    "reversal_rate": """
WITH q AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, quarter(l_shipdate) AS quarter, l_linestatus,
         count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100.0 AS pct, count(*) AS total
  FROM lineitem GROUP BY ALL
),
c AS (SELECT *, CAST(round(pct * total / 100.0) AS BIGINT) AS returned FROM q),
y AS (SELECT year, l_linestatus, sum(returned) / sum(total) * 100.0 AS pct FROM c GROUP BY ALL)
SELECT coalesce(f.year, o.year) AS year, f.pct AS F_pct, o.pct AS O_pct
FROM (SELECT * FROM y WHERE l_linestatus = 'F') f FULL OUTER JOIN (SELECT * FROM y WHERE l_linestatus = 'O') o
  ON f.year = o.year""",
    "multiplicity_factors": """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines, count(DISTINCT l_orderkey) AS orders,
       count(DISTINCT l_partkey) AS parts, count(*) / count(DISTINCT l_orderkey) AS lines_per_order,
       count(*) / count(DISTINCT l_partkey) AS lines_per_part
FROM lineitem GROUP BY 1""",
    "member_share": with_(COUNTRY) + """
, j AS (
  SELECT b.year, r.r_name AS owner, b.nation, b.reports,
         sum(b.reports) OVER (PARTITION BY b.year) AS total,
         sum(b.reports) OVER (PARTITION BY b.year, r.r_name) AS owner_reports
  FROM base b JOIN nation n ON b.nation = n.n_name JOIN region r ON n.n_regionkey = r.r_regionkey
)
SELECT year, nation AS member, reports AS member_reports, owner_reports::BIGINT AS owner_reports, total::BIGINT AS total,
       owner_reports / total * 100.0 AS owner_pct, reports / owner_reports * 100.0 AS member_pct
FROM j WHERE owner = 'ASIA'""",
    "share_derived_count": """
WITH g AS (
  SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS qidx, count(*) AS total,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS cat,
         count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS sub
  FROM orders GROUP BY 1
)
SELECT qidx, total, CAST(cat AS DOUBLE) / CAST(total AS DOUBLE) AS category_share,
       CAST(sub AS DOUBLE) / CAST(cat AS DOUBLE) AS subcategory_share,
       CAST(trunc(total * (CAST(cat AS DOUBLE) / CAST(total AS DOUBLE)) * (CAST(sub AS DOUBLE) / CAST(cat AS DOUBLE))) AS BIGINT) AS derived
FROM g""",
    "bucket_taxonomies": """
WITH tax(taxonomy, bucket, member) AS (VALUES
  ('size', 'compact', 'SMALL'), ('size', 'compact', 'MEDIUM'), ('size', 'bulky', 'LARGE'),
  ('grade', 'basic', 'ECONOMY'), ('grade', 'basic', 'STANDARD'), ('grade', 'promoted', 'PROMO')),
li AS (SELECT l_partkey, sum(l_quantity) AS qty, count(*) AS lines FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS label FROM part)
SELECT taxonomy, bucket, sum(qty) AS qty, sum(lines)::BIGINT AS lines
FROM li JOIN p ON l_partkey = p_partkey JOIN tax ON label = member GROUP BY ALL""",
    "interleaved_share_pivot": STATUS + """
SELECT year,
  sum(orders) FILTER (WHERE status = 'F')::BIGINT AS "F", sum(share) FILTER (WHERE status = 'F') AS "F_pct",
  sum(orders) FILTER (WHERE status = 'O')::BIGINT AS "O", sum(share) FILTER (WHERE status = 'O') AS "O_pct",
  sum(orders) FILTER (WHERE status = 'P')::BIGINT AS "P", sum(share) FILTER (WHERE status = 'P') AS "P_pct",
  CASE WHEN count(orders) > 0 THEN sum(orders)::BIGINT END AS total
FROM shares GROUP BY year""",
    "split_name_unpivot": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS value,
       'F' AS status, 'customers' AS variable FROM orders GROUP BY 1
UNION ALL
SELECT CAST(year(o_orderdate) AS INTEGER), count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O'), 'O', 'customers'
FROM orders GROUP BY 1
UNION ALL
SELECT CAST(year(o_orderdate) AS INTEGER), count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'P'), 'P', 'customers'
FROM orders GROUP BY 1""",
    "reach_q2": """
WITH q2 AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS active
            FROM orders WHERE quarter(o_orderdate) = 2 GROUP BY 1),
y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS population FROM orders GROUP BY 1)
SELECT q2.year, active, population, active / population * 100.0 AS reach_pct FROM q2 LEFT JOIN y ON q2.year = y.year""",
})

# ---------------------------------------------------------------------------
# Parsing, quality, keys, statements, computed columns

from veracity.functions.cells import PERCENT_EXPR_PATTERN, PERCENT_RANGE_PATTERN  # noqa: E402
from veracity.sources import statements as _S  # noqa: E402


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CELLS = """
cells AS (
  SELECT o_orderkey,
         format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS count_text,
         CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS VARCHAR) || '.'
           || lpad(CAST(CAST(floor(o_totalprice % 100) AS BIGINT) AS VARCHAR), 2, '0') AS pct
         , o_totalprice
  FROM orders
),
texts AS (
  SELECT o_orderkey, count_text, pct || ' / 100 * ' || count_text AS expr_text, pct || '%' AS percent_text,
         CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) || '%-'
           || CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) + 1 AS VARCHAR) || '%' AS range_text
  FROM cells
)"""

STATEMENTS = f"""
st AS (
  SELECT 'doc-' || CAST(d.doc_id AS VARCHAR) AS uuid,
    CASE d.lang WHEN 'en' THEN 'CONTENT_TYPE_TEXT' WHEN 'fr' THEN 'CONTENT_TYPE_VIDEO'
                WHEN 'de' THEN 'CONTENT_TYPE_IMAGE' ELSE 'CONTENT_TYPE_SCRIPT' END AS content_type,
    NULL::VARCHAR AS content_type_other,
    DATE '1999-12-01' + CAST(trunc(d.n_chars / 10) AS INTEGER) AS content_date,
    upper(d.lang) AS content_language,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN ['DECISION_VISIBILITY_CONTENT_REMOVED']
         WHEN l.quality = 0 THEN ['DECISION_VISIBILITY_CONTENT_DEMOTED']
         WHEN l.quality IS NOT NULL THEN ['DECISION_VISIBILITY_CONTENT_LABELLED']
         ELSE []::VARCHAR[] END AS decision_visibility,
    NULL::VARCHAR AS decision_visibility_other, NULL::VARCHAR AS decision_monetary,
    NULL::VARCHAR AS decision_monetary_other, NULL::VARCHAR AS decision_provision,
    CASE WHEN coalesce(l.toxic, 0) = 1 AND l.quality = 0 THEN 'DECISION_ACCOUNT_SUSPENDED' END AS decision_account,
    DATE '2019-12-15' + CAST(trunc(d.n_chars / 20) AS INTEGER) AS application_date,
    CASE d.lang WHEN 'en' THEN {_list(_S.EEA)} WHEN 'fr' THEN {_list(_S.EU)}
                WHEN 'de' THEN {_list(_S.EU + ['CH'])} ELSE ['ES', 'PT'] END AS territorial_scope,
    d.text AS decision_facts,
    CASE WHEN l.quality IS NOT NULL THEN 'SOURCE_TRUSTED_FLAGGER' ELSE 'SOURCE_VOLUNTARY' END AS source_type,
    NULL::VARCHAR AS source_identity, NULL::VARCHAR AS account_type,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'AUTOMATED_DECISION_FULLY' ELSE 'AUTOMATED_DECISION_NOT_AUTOMATED' END
      AS automated_decision,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'DECISION_GROUND_ILLEGAL_CONTENT'
         ELSE 'DECISION_GROUND_INCOMPATIBLE_CONTENT' END AS decision_ground,
    CASE WHEN coalesce(l.toxic, 0) = 1 AND l.quality = 1 THEN 'Article 2' END AS illegal_content_legal_ground,
    NULL::VARCHAR AS illegal_content_explanation,
    CASE WHEN NOT coalesce(l.toxic, 0) = 1 AND l.quality IS NOT NULL THEN 'Terms of service' END
      AS incompatible_content_ground,
    NULL::VARCHAR AS incompatible_content_explanation,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'STATEMENT_CATEGORY_ILLEGAL_OR_HARMFUL_SPEECH'
         WHEN l.quality = 0 THEN 'STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE'
         WHEN l.quality IS NOT NULL THEN 'STATEMENT_CATEGORY_SCAMS_AND_FRAUD'
         ELSE 'STATEMENT_CATEGORY_OTHER' END AS category,
    []::VARCHAR[] AS category_addition,
    CASE WHEN coalesce(l.toxic, 0) = 1 THEN ['KEYWORD_HATE_SPEECH', 'KEYWORD_DEFAMATION']
         WHEN l.quality = 0 THEN ['KEYWORD_OTHER'] ELSE []::VARCHAR[] END AS category_specification,
    NULL::VARCHAR AS category_specification_other
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def _violation_sql() -> str:
    parts = []

    def rule(field, name, cond):
        parts.append(f"SELECT uuid, '{field}' AS field, '{name}' AS rule FROM st WHERE coalesce({cond}, false)")

    for name, allowed in _S.ENUMS.items():
        rule(name, "enum", f"{name} IS NOT NULL AND {name} NOT IN ({', '.join(repr(v) for v in allowed)})")
    for name, allowed in _S.SET_ENUMS.items():
        rule(name, "enum", f"len(list_filter(coalesce({name}, []::VARCHAR[]), lambda x: NOT list_contains({_list(allowed)}, x))) > 0")
    for name, limit in _S.MAX_LENGTH.items():
        rule(name, "max_length", f"length({name}) > {limit}")
    for name, first in _S.MIN_DATE.items():
        rule(name, "min_date", f"{name} < DATE '{first}'")
    rule("decision_facts", "required", "decision_facts IS NULL OR length(decision_facts) = 0")
    rule("decision_visibility", "at_least_one_restriction",
         "coalesce(len(decision_visibility), 0) <= 0 AND decision_monetary IS NULL "
         "AND decision_provision IS NULL AND decision_account IS NULL")
    rule("content_type_other", "required", "content_type = 'CONTENT_TYPE_OTHER' AND content_type_other IS NULL")
    rule("decision_visibility_other", "required",
         "list_contains(coalesce(decision_visibility, []::VARCHAR[]), 'DECISION_VISIBILITY_OTHER') "
         "AND decision_visibility_other IS NULL")
    rule("decision_monetary_other", "required",
         "decision_monetary = 'DECISION_MONETARY_OTHER' AND decision_monetary_other IS NULL")
    rule("illegal_content_legal_ground", "required",
         "decision_ground = 'DECISION_GROUND_ILLEGAL_CONTENT' AND illegal_content_legal_ground IS NULL")
    rule("incompatible_content_ground", "required",
         "decision_ground = 'DECISION_GROUND_INCOMPATIBLE_CONTENT' AND incompatible_content_ground IS NULL")
    return "\nUNION ALL\n".join(parts)


QUARTERLY = with_(SERIES)
LINE_METRICS = """
lm AS (
  SELECT l_returnflag AS entity, printf('%04d Q%d', year(l_shipdate), quarter(l_shipdate)) AS label,
         sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS lines,
         sum(round(l_extendedprice * 100)) AS gross, sum(round(l_extendedprice * l_tax * 100)) AS tax
  FROM lineitem GROUP BY ALL
),
base_long AS (
  SELECT entity, label, 'qty' AS metric, qty AS value FROM lm
  UNION ALL SELECT entity, label, 'lines', lines FROM lm
  UNION ALL SELECT entity, label, 'gross', gross FROM lm
)"""

SENDER_DATES = """
sp AS (
  SELECT entity, year, freq, part,
         CASE freq WHEN 'Q' THEN printf('%04d Q%d', year, part) ELSE printf('%04d H%d', year, part) END AS label,
         make_date(year, CASE freq WHEN 'Q' THEN (part - 1) * 3 + 1 ELSE (part - 1) * 6 + 1 END, 1) AS start
  FROM sender_periodic
),
spd AS (
  SELECT entity, label, start,
         last_day(start + CASE freq WHEN 'Q' THEN INTERVAL 2 MONTH ELSE INTERVAL 5 MONTH END) AS "end"
  FROM sp
)"""

ORACLE.update({
    "parse_periods": """
WITH yq AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter
            FROM orders),
t AS (SELECT year, quarter, year * 4 + quarter - 1 AS qidx, CAST(floor((quarter - 1) / 2) + 1 AS INTEGER) AS half,
             make_date(year, (quarter - 1) * 3 + 1, 1) AS qs FROM yq)
SELECT qidx, printf('%04d Q%d', year, quarter) AS q_label, 'Q' AS q_freq, qs AS q_start,
       last_day(qs + INTERVAL 2 MONTH) AS q_end,
       printf('%04d H%d', year, half) AS h_label, 'H' AS h_freq, make_date(year, (half - 1) * 6 + 1, 1) AS h_start,
       last_day(make_date(year, (half - 1) * 6 + 1, 1) + INTERVAL 5 MONTH) AS h_end,
       printf('%04d', year) AS y_label, make_date(year, 1, 1) AS y_start, make_date(year, 12, 31) AS y_end,
       ['Jan-Mar', 'Apr-Jun', 'Jul-Sep', 'Oct-Dec'][quarter] || ' ' || printf('%04d', year) AS months_label,
       qidx AS months_qidx, printf('%04dq%d', year, quarter) AS compact_label, qidx AS compact_qidx,
       printf('Q%d-%04d', quarter, year) AS dash_label, printf('_q%d_%04d', quarter, year) AS suffix_label
FROM t""",
    "parse_cells": with_(CELLS) + f"""
SELECT o_orderkey, count_text, CAST(replace(count_text, ',', '') AS BIGINT) AS count, expr_text,
       CAST(regexp_extract(expr_text, '{PERCENT_EXPR_PATTERN}', 1) AS DOUBLE) AS expr_percent,
       CAST(replace(regexp_extract(expr_text, '{PERCENT_EXPR_PATTERN}', 2), ',', '') AS BIGINT) AS expr_total,
       CAST(regexp_extract(expr_text, '{PERCENT_EXPR_PATTERN}', 1) AS DOUBLE) / 100.0
         * CAST(replace(regexp_extract(expr_text, '{PERCENT_EXPR_PATTERN}', 2), ',', '') AS BIGINT) AS expr_value,
       CAST(rtrim(percent_text, '%') AS DOUBLE) AS percent
FROM texts""",
    "range_midpoint": with_(CELLS) + f"""
SELECT o_orderkey, range_text,
       (CAST(regexp_extract(range_text, '{PERCENT_RANGE_PATTERN}', 1) AS DOUBLE)
        + CAST(regexp_extract(range_text, '{PERCENT_RANGE_PATTERN}', 2) AS DOUBLE)) / 2.0 AS midpoint
FROM texts""",
    "sig_digits_3": """
SELECT o_orderkey, o_totalprice,
       CAST(printf('%.3g', o_totalprice) AS DOUBLE) AS sig3
FROM orders""",
    "quality_checks": with_(COUNTRY) + """
, oc AS (SELECT count(*) FILTER (WHERE o_custkey IS NULL) AS nulls, count(DISTINCT o_orderstatus) AS statuses,
                count(DISTINCT o_orderkey) AS keys, count(*) AS n FROM orders),
pcc AS (SELECT sum(reports_pct) / count(DISTINCT year) AS pct, sum(reports) AS reports,
               count(DISTINCT nation) AS nations FROM pc),
raw AS (
  SELECT 'orders_null_custkey' AS c, 0.0 AS e, CAST(nulls AS DOUBLE) AS a, 0.0 AS tol FROM oc
  UNION ALL SELECT 'orders_status_values', 3.0, CAST(statuses AS DOUBLE), 0.0 FROM oc
  UNION ALL SELECT 'orders_unique_keys', CAST(n AS DOUBLE), CAST(keys AS DOUBLE), 0.0 FROM oc
  UNION ALL SELECT 'reports_pct_sum_per_year', 100.0, pct, 1e-9 FROM pcc
  UNION ALL SELECT 'parts_equal_total', (SELECT CAST(count(*) AS DOUBLE) FROM orders), CAST(reports AS DOUBLE), 0.0 FROM pcc
  UNION ALL SELECT 'nations_with_reports', 25.0, CAST(nations AS DOUBLE), 0.0 FROM pcc
)
SELECT c AS "check", e AS expected, round(a, 9) AS actual, abs(a - e) <= tol AS ok FROM raw""",
    "period_gaps": with_(FACTS, SENDER, SENDER_DATES) + """
SELECT entity, label, next_label, CAST(date_diff('day', "end", next_start) - 1 AS INTEGER) AS gap_days
FROM (SELECT entity, label, "end", lead(label) OVER w AS next_label, lead(start) OVER w AS next_start
      FROM (SELECT DISTINCT * FROM spd) WINDOW w AS (PARTITION BY entity ORDER BY start, "end"))
WHERE next_start IS NOT NULL AND date_diff('day', "end", next_start) - 1 <> 0""",
    "record_violations": with_(FACTS, SENDER, SENDER_LONG) + """
, cnt AS (
  SELECT entity, CASE freq WHEN 'Q' THEN printf('%04d Q%d', year, part) ELSE printf('%04d H%d', year, part) END AS label,
         count(value) AS cells
  FROM knocked GROUP BY ALL
)
SELECT entity, 'cell_count' AS rule, label || ' ' || CAST(cells AS VARCHAR) AS detail FROM cnt WHERE cells <> 2
UNION ALL
SELECT n_name, 'unknown_source', 'items' FROM nation
WHERE n_nationkey % 2 = 0 AND n_name IN (SELECT entity FROM sender_periodic)""",
    "statement_violations": with_(STATEMENTS) + _violation_sql(),
    "territory_coverage": with_(STATEMENTS) + f"""
SELECT territory, count(*) AS statements
FROM (SELECT unnest(list_distinct(coalesce(territorial_scope, []::VARCHAR[]))) AS territory FROM st) GROUP BY 1
UNION ALL
SELECT 'EU', count(*) FILTER (WHERE len(list_filter({_list(_S.EU)},
                                 lambda x: NOT list_contains(coalesce(territorial_scope, []::VARCHAR[]), x))) = 0) FROM st
UNION ALL
SELECT 'EEA', count(*) FILTER (WHERE len(list_filter({_list(_S.EEA)},
                                  lambda x: NOT list_contains(coalesce(territorial_scope, []::VARCHAR[]), x))) = 0) FROM st""",
    "term_explode": with_(STATEMENTS) + """
SELECT keyword, count(*) AS statements FROM (SELECT unnest(category_specification) AS keyword FROM st) GROUP BY 1""",
    "terms_joined": with_(STATEMENTS) + """
SELECT uuid, array_to_string(category_specification, '; ') AS terms,
       CAST(len(category_specification) AS INTEGER) AS n_terms FROM st""",
    "survey_counts": """
WITH rich AS (SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000.0))
SELECT 'surveyed' AS measure, count(DISTINCT n_name) AS n FROM nation
UNION ALL SELECT 'firms', count(DISTINCT n_name) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'disclosing', count(DISTINCT n_name) FROM rich
UNION ALL SELECT 'silent', count(DISTINCT n_name) FROM nation WHERE n_name NOT IN (SELECT n_name FROM rich)""",
    "extreme_keys": """
SELECT n.n_name AS nation, min(o.o_totalprice) AS min_price,
       min({'p': o.o_totalprice, 'k': o.o_orderkey}).k AS min_key,
       max(o.o_totalprice) AS max_price,
       -(max({'p': o.o_totalprice, 'k': -o.o_orderkey}).k) AS max_key
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1""",
    "key_repair_overrides": with_(COUNTRY) + """
, codes AS (
  SELECT n.n_name AS nation,
         CASE WHEN r.r_name = 'AFRICA' THEN '-99' ELSE 'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') END AS code
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
repairs(nation, fixed) AS (VALUES ('NATION_0', 'N00'), ('NATION_5', 'N05')),
codes2 AS (SELECT c.nation, coalesce(nullif(c.code, '-99'), rp.fixed) AS code
           FROM codes c LEFT JOIN repairs rp ON c.nation = rp.nation),
overrides(nation, year, new_value) AS (VALUES ('NATION_1', 1996, NULL::BIGINT), ('NATION_2', 1997, 0::BIGINT)),
fixed AS (
  SELECT b.nation, b.year, CASE WHEN o.nation IS NOT NULL THEN o.new_value ELSE b.reports END AS reports, b.population
  FROM base b LEFT JOIN overrides o ON b.nation = o.nation AND b.year = o.year
)
SELECT f.nation, coalesce(c.code, 'UNK') AS code, f.year, coalesce(f.reports, 0) AS reports, f.population
FROM fixed f LEFT JOIN codes2 c ON f.nation = c.nation""",
    "scalar_base_lookup": """
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM orders GROUP BY 1)
SELECT year, orders, (SELECT max(orders) FROM y WHERE year = 1995) AS base,
       CAST(orders AS DOUBLE) / CAST((SELECT max(orders) FROM y WHERE year = 1995) AS DOUBLE) * 100.0 AS pct_of_base
FROM y""",
    "label_column": with_(COUNTRY) + """
SELECT nation, year, printf('%s:<br>%.5f (%s)', nation, reports_per_capita,
       CASE WHEN reports >= 1000000 THEN printf('%.1fM', reports / 1000000.0)
            WHEN reports >= 1000 THEN printf('%.1fk', reports / 1000.0)
            ELSE printf('%d', reports) END) AS label
FROM pc""",
    "brand_columns_side_by_side": QUARTERLY + """
SELECT coalesce(a.qidx, b.qidx) AS qidx, a.orders AS "NATION_1", b.orders AS "NATION_2"
FROM (SELECT * FROM quarterly WHERE nation = 'NATION_1') a
FULL OUTER JOIN (SELECT * FROM quarterly WHERE nation = 'NATION_2') b ON a.qidx = b.qidx""",
    "key_set_difference": """
WITH wc AS (SELECT n_name AS nation FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
rich AS (SELECT n_name AS nation FROM nation
         WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000.0))
SELECT nation, 'customers_only' AS side FROM wc WHERE nation NOT IN (SELECT nation FROM rich)
UNION ALL SELECT nation, 'suppliers_only' FROM rich WHERE nation NOT IN (SELECT nation FROM wc)""",
    "ownership_set_union": """
WITH own AS (SELECT r_name AS owner, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT owner, member FROM (
  SELECT owner, member FROM own
  UNION ALL
  SELECT owner, array_to_string(list_transform(string_split(lower(owner), ' '),
                                               lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') FROM own)""",
    "computed_columns_sum": with_(LINE_METRICS) + """
SELECT * FROM base_long
UNION ALL SELECT entity, label, 'tax', tax + qty FROM lm
UNION ALL SELECT entity, label, 'charge', gross + tax FROM lm""",
    "computed_columns_product": with_(LINE_METRICS) + """
SELECT * FROM base_long
UNION ALL SELECT entity, label, 'tax', tax FROM lm
UNION ALL SELECT entity, label, 'volume', qty * lines FROM lm""",
})

ORACLE.update({
    "csv_roundtrip": with_(COUNTRY) + """
SELECT nation, CASE WHEN nation = 'NATION_0' THEN 'NA' ELSE 'N' || regexp_extract(nation, '(\\d+)$', 1) END AS code,
       year, reports, population FROM base""",
    "json_collection_roundtrip": with_(FACTS, SENDER) + """
, rows AS (
  SELECT entity, CASE freq WHEN 'Q' THEN printf('%04d Q%d', year, part) ELSE printf('%04d H%d', year, part) END AS label,
         year, reports, pieces, false AS redundant FROM sender_periodic
  UNION ALL
  SELECT n_name, printf('%04d', year), year, CAST(sum(orders) AS DOUBLE), CAST(sum(lines) AS DOUBLE), true
  FROM facts GROUP BY n_name, year
)
SELECT entity, entity AS observer, label, year, 'reports' AS metric, reports AS value, redundant FROM rows
UNION ALL SELECT entity, entity, label, year, 'pieces', pieces, redundant FROM rows""",
    "snapshot_files_roundtrip": SNAP + "SELECT nation, priority, status, period, snapshot, cents FROM snaps",
})

ORACLE["snapshot_stream_diff"] = SNAP + "SELECT * FROM diffs"

ORACLE["pipe_batches_roundtrip"] = with_(COUNTRY) + "SELECT nation, year, population FROM base"

ORACLE["converters_roundtrip"] = """
WITH t AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, lower(o_orderpriority) AS priority,
         CAST(printf('%.2f', sum(o_totalprice)) AS DOUBLE) AS x
  FROM orders GROUP BY 1, 2
)
SELECT year, priority,
       CAST(printf('%.3g', x) AS DOUBLE) AS total_3sig
FROM t"""


def _schema_profile_sql() -> str:
    """Null counts per column computed by DuckDB; names and Spark type names
    come from the declared table schemas the Spark scan also uses."""
    from veracity.sources.tables import TABLE_SCHEMAS

    parts = []
    for table, ddl in TABLE_SCHEMAS.items():
        for pos, field in enumerate(f.strip() for f in ddl.split(", ")):
            name, spark_type = field.split(" ", 1)
            parts.append(
                f"SELECT '{table}' AS \"table\", CAST({pos} AS INTEGER) AS position, '{name}' AS \"column\", "
                f"'{spark_type}' AS type, count(*) FILTER (WHERE {name} IS NULL) AS nulls FROM {table}")
    return "\nUNION ALL\n".join(parts)


ORACLE["schema_profile"] = _schema_profile_sql()

ORACLE["disclosure_features"] = with_(FACTS, SENDER) + """
SELECT DISTINCT entity,
       CASE WHEN max(freq) OVER (PARTITION BY entity) = 'Q' THEN 'quarterly' ELSE 'half-yearly' END AS granularity,
       'pieces; reports' AS terms, true AS has_reports
FROM sender_periodic"""

ORACLE["country_pipeline"] = """
WITH cell AS (
  SELECT n.n_name AS iso3, CAST(CAST(year(o.o_orderdate) AS INTEGER) AS VARCHAR) AS year,
         count(*) AS reports, count(DISTINCT o.o_custkey) AS population,
         count(DISTINCT CASE WHEN c.c_acctbal > 0 THEN o.o_custkey END) AS online
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL
),
grid AS (
  SELECT i.iso3, y.year, coalesce(c.reports, 0) AS reports
  FROM (SELECT DISTINCT iso3 FROM cell) i CROSS JOIN (SELECT DISTINCT year FROM cell) y
  LEFT JOIN cell c ON c.iso3 = i.iso3 AND c.year = y.year
),
rep AS (
  SELECT iso3, year, CAST(reports AS BIGINT) AS reports,
         CAST(reports AS DOUBLE) / sum(CAST(reports AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS reports_pct
  FROM grid
),
pop AS (
  SELECT iso3, year, population,
         CAST(population AS DOUBLE) / sum(CAST(population AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS population_pct,
         online, CAST(online AS DOUBLE) / sum(CAST(online AS DOUBLE)) OVER (PARTITION BY year) * 100.0 AS online_pct
  FROM cell
),
regions(superregion, region) AS (
  SELECT 'WORLD', r_name FROM region UNION ALL SELECT 'GLOBE', 'WORLD'
),
levels AS (
  SELECT r.region, r.superregion, coalesce(up.superregion, r.superregion) AS continent
  FROM regions r LEFT JOIN regions up ON r.superregion = up.region
),
league AS (
  SELECT n_name AS iso3 FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0)
),
joined AS (
  SELECT r.iso3, r.year, r.reports, r.reports_pct, p.population, p.population_pct,
         CAST(r.reports AS DOUBLE) / CAST(p.population AS DOUBLE) AS reports_per_capita,
         p.online, p.online_pct, lower(n.n_name) AS country, 'N' || CAST(n.n_nationkey AS VARCHAR) AS iso2,
         rg.r_name AS region, l.superregion, l.continent, r.iso3 IN (SELECT iso3 FROM league) AS league
  FROM rep r JOIN pop p ON r.iso3 = p.iso3 AND r.year = p.year
  LEFT JOIN nation n ON n.n_name = r.iso3 LEFT JOIN region rg ON n.n_regionkey = rg.r_regionkey
  LEFT JOIN levels l ON l.region = rg.r_name
)
SELECT iso3, year, reports, round(reports_pct, 9) AS reports_pct, population, round(population_pct, 9) AS population_pct,
       reports_per_capita, online, online_pct, country, iso2, region, superregion, continent, league
FROM joined
UNION ALL
SELECT '☪', year, CAST(sum(reports) AS BIGINT), round(sum(reports_pct), 9), CAST(sum(population) AS BIGINT),
       round(sum(population_pct), 9), CAST(sum(reports) AS DOUBLE) / CAST(sum(population) AS DOUBLE),
       NULL, NULL, 'League', '☪', NULL, NULL, NULL, false
FROM joined WHERE league GROUP BY year"""

ORACLE["returns_fisher_by_year"] = """
WITH t AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (WHERE l_discount >= 0.05 AND l_returnflag = 'R') AS a,
         count(*) FILTER (WHERE l_discount >= 0.05 AND l_returnflag <> 'R') AS b,
         count(*) FILTER (WHERE NOT l_discount >= 0.05 AND l_returnflag = 'R') AS c,
         count(*) FILTER (WHERE NOT l_discount >= 0.05 AND l_returnflag <> 'R') AS d
  FROM lineitem GROUP BY 1
), x AS (
  SELECT *, unnest(range(greatest(0, a - d), least(a + c, a + b) + 1)) AS x FROM t
), p AS (
  SELECT *, lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1)
            - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1) AS lp FROM x
), own AS (SELECT year, lp AS own FROM p WHERE x = a
), tests AS (
  SELECT year, sum(exp(lp)) FILTER (WHERE x >= a) AS greater, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7) AS two_sided
  FROM p JOIN own USING (year) GROUP BY year
), majority AS (
  SELECT year, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) AS m
  FROM (SELECT year, a + b + c + d AS n, unnest(range(a + b, a + b + c + d + 1)) AS i FROM t) GROUP BY year
)
SELECT year, a, b, c, d, round(least(greater, 1), 9) AS p_greater, round(least(two_sided, 1), 9) AS p_two_sided,
       round(least(m, 1), 9) AS p_majority
FROM t JOIN tests USING (year) JOIN majority USING (year)"""
