"""The queries as SQL for DuckDB: named steps, and a select over the steps that it needs."""

from __future__ import annotations

import re

from .sources.registry import SAMPLE

CONTROL_NAMES = ("realized_vol", "drawdown", "trailing_return")


def abs_d(s1: str, s2: str, t1: str, t2: str, n: str, total: str) -> str:
    inner = f"greatest({s2} - ({s1}) * ({s1}) / {n}, 0)"
    outer = f"greatest({t2} - ({s2}) - ({t1} - ({s1})) * ({t1} - ({s1})) / ({total} - {n}), 0)"
    sp = f"sqrt(({inner} + {outer}) / ({total} - 2))"
    return f"CASE WHEN {n} >= 1 AND {total} - {n} >= 1 THEN CASE WHEN {sp} > 0 THEN abs((({s1}) / {n} - ({t1} - ({s1})) / ({total} - {n})) / {sp}) ELSE 0 END END"


def _panel(by: str, values: dict[str, str]) -> str:
    prices = ", ".join(f"sum(l_extendedprice) FILTER (WHERE {by} = '{v}') / sum(l_quantity) FILTER (WHERE {by} = '{v}') AS {a}" for v, a in values.items())
    keep = " AND ".join(f"{a} IS NOT NULL" for a in values.values())
    return f"SELECT *, row_number() OVER (ORDER BY ts) - 1 AS ppos FROM (SELECT CAST(l_shipdate AS DATE) AS ts, {prices} FROM lineitem GROUP BY 1) WHERE {keep}"


def _returns(panel: str, assets: str) -> str:
    return f"SELECT ts, ppos, {', '.join(assets)}, " + ", ".join(f"ln({a}) - lag(ln({a})) OVER (ORDER BY ts) AS {a}_ret" for a in assets) + f" FROM {panel}"


def _full(f: str, n: int) -> str:
    return f"CASE WHEN count({f.split('(')[1].split(')')[0]}) OVER w{n} = {n} THEN {f} OVER w{n} END"


def corr(a: str, b: str, n: int) -> str:
    return f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER w{n} = {n} AND stddev_pop({a}) OVER w{n} > 0 AND stddev_pop({b}) OVER w{n} > 0 THEN corr({a}, {b}) OVER w{n} END"


def frames(*sizes: int) -> str:
    return "WINDOW " + ", ".join(f"w{n} AS (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


_FEATURES = [f"{a}_{k}" for a in "fo" for k in ("ret", "vol5", "vol20", "mom5", "mom20")] + ["xcorr20"]

STEPS = {
    "px2": _panel("l_linestatus", {"F": "f", "O": "o"}),
    "px3": _panel("l_returnflag", {"A": "a", "N": "n", "R": "r"}),
    "lr2": _returns("px2", "fo"),
    "lr3": _returns("px3", "anr"),
    "feat": "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT ts, "
    + ", ".join(f"{a}_ret, " + ", ".join(f"{_full(f'stddev_samp({a}_ret)', n)} AS {a}_vol{n}, {_full(f'avg({a}_ret)', n)} AS {a}_mom{n}" for n in (5, 20)) for a in "fo")
    + f", {corr('f_ret', 'o_ret', 20)} AS xcorr20 FROM lr2 {frames(5, 20)}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES),
    "ctl": f"SELECT ts, f_ret AS ret, {_full('stddev_samp(f_ret)', 20)} AS realized_vol, 1 - f / max(f) OVER w252 AS drawdown, lag(ln(f), 126) OVER (ORDER BY ts) - ln(f) AS trailing_return FROM lr2 {frames(20, 252)}",
    "cv": " UNION ALL ".join(f"SELECT '{c}' AS channel, feat.pos, feat.ts, {c} AS value FROM feat JOIN ctl ON ctl.ts = feat.ts" for c in CONTROL_NAMES),
    "sm": "SELECT *, avg(value) OVER (PARTITION BY channel ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM cv",
    "zs": "SELECT channel, pos, ts, value, CASE WHEN pos >= 60 AND sd > 0 THEN (s - mu) / sd END AS z FROM (SELECT *, avg(s) OVER p AS mu, stddev_pop(s) OVER p AS sd FROM sm WINDOW p AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "reg": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in SAMPLE) + ") AS t(crisis, start_month, end_month)",
    "bounds": "SELECT crisis, CAST(start_month || '-01' AS DATE) AS first_day, last_day(CAST(end_month || '-01' AS DATE)) AS last_day FROM reg",
    "span": "SELECT crisis, greatest(0, min(pos) - 10) AS lo, least((SELECT count(*) FROM feat) - 1, max(pos) + 10) AS hi, (SELECT count(*) FROM feat) AS total FROM feat JOIN bounds ON ts BETWEEN first_day AND last_day GROUP BY crisis",
    "mem": "SELECT crisis, pos, ts FROM feat JOIN span ON pos BETWEEN lo AND hi",
    "ctx0": "SELECT m.crisis, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n_window, any_value(lo) AS lo, any_value(hi) AS hi, any_value(total) AS total FROM mem m JOIN span s ON s.crisis = m.crisis GROUP BY m.crisis",
    "ctx1": "SELECT *, CAST(isodow(\"start\") - 1 AS BIGINT) AS wd, least(isodow(\"start\") - 1, 5) - 10 AS idx FROM ctx0",
    "ctx": "SELECT crisis, \"start\", \"end\", \"start\" + CAST(7 * CAST(floor(idx / 5.0) AS BIGINT) + idx - 5 * CAST(floor(idx / 5.0) AS BIGINT) - wd AS INTEGER) AS cutoff, n_window, lo, hi, total FROM ctx1",
    "anyc": "SELECT feat.pos, feat.ts, feat.pos IN (SELECT pos FROM mem) AS in_any FROM feat",
    "fin": "SELECT channel, pos, ts, z, row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS m, count(*) OVER (PARTITION BY channel) AS total FROM zs WHERE z IS NOT NULL",
    "win": "SELECT channel, crisis, min(m) AS lo, max(m) AS hi, count(*) AS len, any_value(total) AS total FROM fin JOIN mem ON mem.pos = fin.pos GROUP BY channel, crisis",
    "dbl": "SELECT channel, m, z FROM fin UNION ALL SELECT channel, m + total, z FROM fin",
    "pre": "SELECT channel, m + 1 AS i, sum(z) OVER w AS c1, sum(z * z) OVER w AS c2 FROM dbl WINDOW w AS (PARTITION BY channel ORDER BY m ROWS UNBOUNDED PRECEDING) UNION ALL SELECT DISTINCT channel, 0, 0.0, 0.0 FROM fin",
    "shs": "SELECT *, (lo - draw_id + total) % total AS start FROM (SELECT *, unnest(range(1, total)) AS draw_id FROM win)",
    "was": "SELECT *, start AS draw_id FROM (SELECT *, unnest(range(0, total - len + 1)) AS start FROM win) WHERE start + len - 1 < lo OR start > hi",
    "res": "SELECT *, lo AS start FROM win",
    **{name: f"SELECT q.channel, q.crisis, q.lo, q.hi, q.len, q.total, q.start, {extra} {abs_d('b.c1 - a.c1', 'b.c2 - a.c2', 't.c1', 't.c2', 'q.len', 'q.total')} AS d FROM {src} q JOIN pre a ON a.channel = q.channel AND a.i = q.start JOIN pre b ON b.channel = q.channel AND b.i = q.start + q.len JOIN pre t ON t.channel = q.channel AND t.i = q.total" for name, src, extra in (("shd", "shs", "q.draw_id,"), ("wad", "was", "q.draw_id,"), ("real", "res", ""))},
    "first_cut": "SELECT cutoff FROM ctx ORDER BY \"start\" LIMIT 1",
    "cal": "SELECT a.*, a.ts < cutoff AS block, a.ts >= cutoff AS forward FROM anyc a, first_cut",
    "zc": "SELECT zs.channel, zs.pos, zs.ts, zs.z, cal.block, cal.forward, cal.in_any FROM zs JOIN cal ON cal.pos = zs.pos",
    "blk": "SELECT *, coalesce(lag(z) OVER (PARTITION BY channel ORDER BY pos), CAST('-infinity' AS DOUBLE)) AS before FROM zc WHERE block",
    "cand": "SELECT DISTINCT channel, z AS tau FROM blk WHERE z IS NOT NULL",
    "swp": "SELECT c.channel, c.tau, count(b.pos) AS upcrossings FROM cand c LEFT JOIN blk b ON b.channel = c.channel AND b.z > c.tau AND b.before <= c.tau GROUP BY c.channel, c.tau",
    "goal": "SELECT channel, count(z) / 252.0 AS years, CAST(greatest(1, round_even(count(z) / 252.0, 0)) AS INTEGER) AS target_count FROM blk GROUP BY channel",
    "tau": "SELECT channel, tau, upcrossings / years AS block_far, target_count FROM (SELECT s.*, g.years, g.target_count, row_number() OVER (PARTITION BY s.channel ORDER BY abs(upcrossings - target_count), tau DESC) AS nth FROM swp s JOIN goal g ON g.channel = s.channel) WHERE nth = 1",
    "fir": "SELECT zc.*, coalesce(z > tau, false) AS firing FROM zc JOIN tau ON tau.channel = zc.channel",
    "upx": "SELECT *, firing AND NOT coalesce(lag(firing) OVER (PARTITION BY channel ORDER BY pos), false) AS upcross FROM fir",
    "fmem": "SELECT mem.crisis, mem.pos FROM mem JOIN cal ON cal.pos = mem.pos WHERE cal.forward",
    "det": "SELECT channel, crisis, min(u.pos) AS st, min(CASE WHEN firing THEN u.pos END) AS hit FROM upx u JOIN fmem ON fmem.pos = u.pos WHERE forward GROUP BY channel, crisis",
    "fwd": "SELECT channel, pos, firing, row_number() OVER (PARTITION BY channel ORDER BY pos) - 1 AS m, count(*) OVER (PARTITION BY channel) AS total FROM upx WHERE forward",
    "hits": "SELECT DISTINCT f.channel, e.crisis, (p.m - f.m + f.total) % f.total AS shift FROM fwd f JOIN fwd p ON p.channel = f.channel JOIN fmem e ON e.pos = p.pos WHERE f.firing",
    "chn": "SELECT s.channel, s.shift, count(h.crisis) AS hits FROM (SELECT DISTINCT channel, unnest(range(1, total)) AS shift FROM fwd) s LEFT JOIN hits h ON h.channel = s.channel AND h.shift = s.shift GROUP BY s.channel, s.shift",
    "xc": f"SELECT ts, ppos, {corr('a_ret', 'n_ret', 60)} AS c_an, {corr('a_ret', 'r_ret', 60)} AS c_ar, {corr('n_ret', 'r_ret', 60)} AS c_nr, count(CASE WHEN a_ret IS NOT NULL AND n_ret IS NOT NULL AND r_ret IS NOT NULL THEN 1 END) OVER w60 AS full_rows FROM lr3 {frames(60)}",
    "xc3": "SELECT ts, ppos, CASE WHEN full_rows = 60 THEN c_an END AS c_an, CASE WHEN full_rows = 60 THEN c_ar END AS c_ar, CASE WHEN full_rows = 60 THEN c_nr END AS c_nr FROM xc",
    "ar3": "SELECT *, CASE WHEN c_an*c_an + c_ar*c_ar + c_nr*c_nr > 0 THEN (1 + 2 * sqrt((c_an*c_an + c_ar*c_ar + c_nr*c_nr) / 3) * cos(acos(greatest(-1.0, least(1.0, c_an * c_ar * c_nr / pow((c_an*c_an + c_ar*c_ar + c_nr*c_nr) / 3, 1.5)))) / 3)) / 3 END AS ar, (c_an - c_ar - c_nr) / 3 AS mc FROM xc3",
}


def build(select: str, **more: str) -> str:
    """select with the steps that it and these name, in order of need."""
    steps = STEPS | more
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)\b", sql) + re.findall(r"\bFROM\s+\w+(?:\s+\w+)?,\s*(\w+)\b", sql):
            if name in steps and name not in order:
                need(steps[name])
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in order) + "\n" + select
