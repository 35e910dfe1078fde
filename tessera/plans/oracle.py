"""SQL building blocks for the equivalents of the panel queries."""

from __future__ import annotations

_BARS = {
    "brand": "SELECT 'B' || ((regexp_extract(p_brand, '(\\d+)', 1)::INT - 1) // 5) AS grp, p_brand AS asset, date_trunc('{unit}'"
        ", l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "type": "SELECT 'ALL' AS grp, p_type AS asset, date_trunc('{unit}', l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) AS px FROM lineitem"
        " JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "nation": "SELECT r_name AS grp, n_name AS asset, date_trunc('{unit}', o_orderdate)::TIMESTAMP AS ts, avg(o_totalprice) AS px FROM orders"
        " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        " GROUP BY 1, 2, 3",
}

_CLEAN = """
dates AS (SELECT grp, count(DISTINCT ts) AS n FROM bars GROUP BY grp),
cover AS (SELECT b.grp, asset FROM bars b JOIN dates d ON b.grp = d.grp WHERE px IS NOT NULL GROUP BY b.grp, asset, n HAVING count(*) > 0.8 * n),
kept AS (SELECT b.* FROM bars b JOIN cover c ON b.grp = c.grp AND b.asset = c.asset),
grid AS (SELECT g.grp, a.asset, g.ts FROM (SELECT DISTINCT grp, ts FROM kept) g JOIN (SELECT DISTINCT grp, asset FROM kept) a ON g.grp = a.grp),
filled AS (SELECT g.grp, g.asset, g.ts, last_value(px IGNORE NULLS) OVER (PARTITION BY g.grp, g.asset ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS px FROM grid g LEFT JOIN kept k ON g.grp = k.grp AND g.asset = k.asset AND g.ts = k.ts),
full_dates AS (SELECT f.grp, ts FROM filled f JOIN (SELECT grp, count(DISTINCT asset) AS n FROM filled GROUP BY grp) c ON f.grp = c.grp GROUP BY f.grp, ts, n HAVING count(px) = n),
panel AS (SELECT f.* FROM filled f JOIN full_dates d ON f.grp = d.grp AND f.ts = d.ts),
ret AS (SELECT grp, asset, ts, t_idx, r FROM (SELECT grp, asset, ts, (row_number() OVER w - 2)::INT AS t_idx, ln(px / lag(px) OVER w) AS r FROM panel WINDOW w AS (PARTITION BY grp, asset ORDER BY ts)) WHERE t_idx >= 0)"""

_CORR = """
pair AS (SELECT x.grp, x.ts, x.t_idx, x.asset AS a, y.asset AS b, x.r AS ra, y.r AS rb FROM ret x JOIN ret y ON x.grp = y.grp AND x.ts = y.ts AND x.asset < y.asset),
corr AS (SELECT grp, ts, t_idx, a, b, CASE WHEN sa * sb > 0 THEN c / (sa * sb) END AS rho FROM
  (SELECT *, covar_samp(ra, rb) OVER w AS c, stddev_samp(ra) OVER w AS sa, stddev_samp(rb) OVER w AS sb FROM pair WINDOW w AS (PARTITION BY grp, a, b ORDER BY t_idx ROWS BETWEEN {frame})) WHERE t_idx >= {first})"""


def bars(panel: str = "brand", unit: str = "week") -> str:
    return f"bars AS ({_BARS[panel].format(unit=unit)})"


def base(panel: str = "brand", unit: str = "week", upto: str = "ret", inclusive: bool = False, window: int = 60) -> str:
    """WITH clause: bars, cleaned panel, log returns, and with ``upto`` = corr the pair correlations of ``window`` rows."""
    out = f"WITH RECURSIVE {bars(panel, unit)}"
    if upto == "bars":
        return out
    out += "," + _CLEAN
    if upto == "corr":
        frame = f"{window - 1} PRECEDING AND CURRENT ROW" if inclusive else f"{window} PRECEDING AND 1 PRECEDING"
        out += "," + _CORR.format(frame=frame, first=window - 1 if inclusive else window)
    return out


FEATURES = ",\nfeat AS (SELECT grp, ts, t_idx, avg(rho) AS mean_corr, stddev_pop(rho) AS std_corr FROM corr GROUP BY grp, ts, t_idx)"
EW = ",\new AS (SELECT grp, ts, t_idx, avg(r) AS r FROM ret GROUP BY grp, ts, t_idx)"
DIST = (
    ",\ndist AS (SELECT grp, ts, a, b, sqrt(greatest(0.0, 2 * (1 - rho))) AS d FROM corr), sym AS (SELECT grp, ts, a, b, d FROM dist"
    " UNION ALL SELECT grp, ts, b, a, d FROM dist)"
)
H1 = (
    DIST
    + """,
rng AS (SELECT e.grp, e.ts, e.a, e.b, e.d FROM dist e WHERE NOT EXISTS (SELECT 1 FROM sym x JOIN sym y ON x.grp = y.grp AND x.ts = y.ts AND x.b = y.b WHERE x.grp = e.grp AND x.ts = e.ts AND x.a = e.a AND y.a = e.b
  AND (x.d, least(x.a, x.b), greatest(x.a, x.b)) < (e.d, e.a, e.b) AND (y.d, least(y.a, y.b), greatest(y.a, y.b)) < (e.d, e.a, e.b))),
h1 AS (SELECT r.grp, r.ts, n AS n_assets, (count(*) - n + 1)::INT AS h1_count FROM rng r JOIN (SELECT grp, ts, ((1 + sqrt(1 + 8 * count(*))) / 2)::INT AS n FROM dist GROUP BY grp, ts) s ON r.grp = s.grp AND r.ts = s.ts GROUP BY r.grp, r.ts, n)"""
)
