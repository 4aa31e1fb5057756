"""Named SQL building blocks (CTEs) of the oracle queries, written for DuckDB."""

from __future__ import annotations

import re

from seriesloom.functions import vocabulary as V

def category_sql(mapping: dict[str, list[int]]) -> str:
    """Category of class {c} from a map of ``functions.vocabulary``."""
    return "CASE " + " ".join(f"WHEN {{c}} IN ({', '.join(map(str, classes))}) THEN '{name}'" for name, classes in mapping.items()) + " END"


def families_sql() -> str:
    """Movement families of class {c} as a list."""
    return "CASE {c} " + " ".join(f"WHEN {c} THEN {names!r}" for c, names in V.FAMILIES.items()) + " END"


PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def using(names: str, body: str) -> str:
    """``body`` preceded by the named blocks and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in PARTS[n][0]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + body


# --- manifest from events -------------------------------------------------------------------------
part("event_rows", (), """
  SELECT event_id AS series_id, user_id AS subject, event_type AS cls, CAST(ts AS DATE) AS period_date, ts AS started,
         user_id || '_' || strftime(ts, '%Y%m%d') AS session_id,
         CAST(json_extract(props, '$.k') AS INTEGER) AS rep_count, value AS duration_s FROM events""")
part("periods", ("event_rows",), """
  SELECT *, dense_rank() OVER (PARTITION BY subject ORDER BY week) AS period_order FROM (
    SELECT subject, period_date, min(period_date) OVER (PARTITION BY subject) AS first_date,
           CAST((period_date - min(period_date) OVER (PARTITION BY subject)) // 7 AS INTEGER) AS week,
           row_number() OVER (PARTITION BY subject ORDER BY period_date) AS session_order
    FROM (SELECT DISTINCT subject, period_date FROM event_rows))""")
part("bouts", ("periods",), """
  SELECT e.*, p.first_date, p.week, p.session_order, p.period_order FROM event_rows e JOIN periods p USING (subject, period_date)""")
part("samples", (), """
  SELECT user_id AS series_id, event_id AS i, (epoch_us(ts) // 1000) AS t_ms, value AS x,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS y, CAST(hour(ts) AS DOUBLE) AS z FROM events""")

# --- packed signals from embeddings ---------------------------------------------------------------
part("vbouts", (), """
  SELECT vec_id AS series_id, vec_id // 64 AS subject, label AS cls,
         CASE WHEN vec_id % 64 < 32 THEN 1 ELSE 2 END AS period_order FROM embeddings""")
part("points", (), """
  SELECT vec_id AS series_id, vec_id // 64 AS subject, label AS cls,
         CASE WHEN vec_id % 64 < 32 THEN 1 ELSE 2 END AS period_order, p // 16 AS c, p % 16 AS s, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, label, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings)""")
part("wpoints", ("points",), """
  SELECT series_id, subject, cls, period_order, w, w * 2 / 8.0::DOUBLE AS t0_s, c, s - w * 2 AS i, v
  FROM points, (SELECT unnest(range(5)) AS w) WHERE s >= w * 2 AND s < w * 2 + 8""")
part("wmeasures", ("wpoints",), """
  SELECT series_id, subject, cls, period_order, w, c AS mi, avg(v) AS m FROM wpoints GROUP BY ALL
  UNION ALL
  SELECT series_id, subject, cls, period_order, w, c + 4 AS mi, stddev_pop(v) AS m FROM wpoints GROUP BY ALL""")
part("smeasures", ("wmeasures",), """
  SELECT series_id, subject, cls, period_order, mi, avg(m) AS m FROM wmeasures GROUP BY ALL""")

# --- seeded plan (seed 7, 3 repeats, 2 new, teams of 2/4/6, 1 or 2 sets) -----------------------------
part("ranked_subjects", ("vbouts",), """
  SELECT repeat, subject, row_number() OVER (PARTITION BY repeat ORDER BY md5('7|' || repeat || '|' || subject), subject) AS rank
  FROM (SELECT DISTINCT subject FROM vbouts), (SELECT unnest(range(1, 4)) AS repeat)""")
part("pool", ("ranked_subjects",), """
  SELECT repeat, subject, CASE WHEN rank <= 2 THEN 'new' ELSE 'candidate' END AS role,
         CASE WHEN rank <= 2 THEN rank ELSE rank - 2 END AS rank FROM ranked_subjects""")
part("roles", ("pool",), "SELECT * FROM pool WHERE role = 'new' OR rank <= 6")
part("set_order", ("roles",), """
  SELECT * FROM (
    SELECT repeat, subject, r.rank AS team_rank, cls, series_id,
           row_number() OVER (PARTITION BY repeat, subject, cls ORDER BY md5('7|' || repeat || '|' || series_id), series_id) AS set_rank
    FROM vbouts JOIN roles r USING (subject) WHERE period_order = 1 AND role = 'candidate') WHERE set_rank <= 2""")
part("grid", (), "SELECT n_team, k FROM (SELECT unnest([2, 4, 6]) AS n_team), (SELECT unnest([1, 2]) AS k)")
part("train", ("set_order", "grid"), """
  SELECT repeat, n_team, k, subject, cls, series_id FROM set_order, grid WHERE team_rank <= n_team AND set_rank <= k""")
part("test", ("roles", "grid"), """
  SELECT repeat, n_team, k, CASE WHEN role = 'new' THEN 'new' ELSE 'recorded' END AS role, subject, cls, series_id
  FROM vbouts JOIN roles r USING (subject), grid
  WHERE period_order > 1 AND (role = 'new' OR r.rank <= n_team)""")

# --- profile learner over the grid ----------------------------------------------------------------
part("profiles", ("train", "smeasures"), """
  SELECT repeat, n_team, k, t.cls, mi, quantile_cont(m, 0.5) AS mu, var_samp(m) AS v
  FROM train t JOIN smeasures s USING (series_id) GROUP BY ALL""")
part("scales", ("profiles",), "SELECT repeat, n_team, k, mi, sqrt(avg(v)) + 1e-9 AS scale FROM profiles GROUP BY ALL")
part("wdist", ("profiles", "scales", "test", "wmeasures"), """
  SELECT t.repeat, t.n_team, t.k, t.role, t.subject, t.cls, t.series_id, w.w, p.cls AS c, sum(((w.m - p.mu) / s.scale) ** 2) AS d
  FROM test t JOIN wmeasures w USING (series_id) JOIN profiles p ON (p.repeat, p.n_team, p.k, p.mi) = (t.repeat, t.n_team, t.k, w.mi)
  JOIN scales s ON (s.repeat, s.n_team, s.k, s.mi) = (t.repeat, t.n_team, t.k, w.mi) GROUP BY ALL""")
part("wproba", ("wdist",), """
  SELECT * EXCLUDE (q), q / sum(q) OVER (PARTITION BY repeat, n_team, k, series_id, w) AS p
  FROM (SELECT *, 1 / (1 + d) AS q FROM wdist)""")
part("wtop", ("wproba",), """
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY repeat, n_team, k, series_id, w ORDER BY p DESC, c) = 1 THEN 1 ELSE 0 END AS top
  FROM wproba""")
part("vote", ("wtop",), """
  SELECT repeat, n_team, k, role, series_id, subject, cls, c, sum(top + 0.001 * p) AS score, count(*) AS n_windows
  FROM wtop GROUP BY ALL""")
part("preds", ("vote",), """
  SELECT repeat, n_team, k, role, series_id, subject, cls AS truth, c AS pred, n_windows FROM (
    SELECT *, row_number() OVER (PARTITION BY repeat, n_team, k, series_id ORDER BY score DESC, c) AS rn FROM vote) WHERE rn = 1""")


def scores_sql(preds: str, keys: str, n_classes: int = 10, pred: str = "pred") -> str:
    """Macro-F1, balanced accuracy and accuracy per group of ``keys`` (comma list, subject included)."""
    return f"""
      SELECT {keys}, CAST(sum(s) AS BIGINT) AS n_bouts, sum(2.0 * tp / (s + q)) / {n_classes} AS macro_f1,
             avg(CASE WHEN s > 0 THEN tp / s::DOUBLE END) AS balanced_acc, sum(tp) / sum(s)::DOUBLE AS accuracy
      FROM (SELECT {keys}, c, sum(t) AS tp, sum(s) AS s, sum(q) AS q FROM (
              SELECT {keys}, truth AS c, 1 AS s, 0 AS q, CAST(truth = {pred} AS INTEGER) AS t FROM {preds}
              UNION ALL SELECT {keys}, {pred} AS c, 0, 1, 0 FROM {preds}) GROUP BY ALL) GROUP BY ALL"""


part("scores", ("preds",), scores_sql("preds", "repeat, n_team, k, role, subject"))
part("ath", ("scores",), "SELECT n_team, k, role, subject, avg(macro_f1) AS macro_f1, count(*) AS n_rows FROM scores GROUP BY ALL")


CHAIN = ("wpoints", "wmeasures", "smeasures", "profiles", "scales", "wdist", "wproba", "wtop", "vote", "preds", "scores")


def derive(suffix: str, first: str, first_sql: str | None = None, needs: tuple[str, ...] = (), anew: tuple[str, ...] = ()) -> str:
    """The chain from ``first`` to the scores once more; returns the name of its scores.

    ``first`` is stated anew by ``first_sql``, or the parts ``anew`` that the chain reads have been, under their names with the suffix.
    """
    again = CHAIN[CHAIN.index(first):]
    rename = lambda text: re.sub(rf"\b({'|'.join((*again, *anew))})\b", lambda m: m[0] + suffix, text)
    if first_sql:
        part(first + suffix, needs, first_sql)
    for name in again[1:] if first_sql else again:
        part(name + suffix, tuple(rename(n) for n in PARTS[name][0]), rename(PARTS[name][1]))
    return "scores" + suffix


def bootstrap_sql(rows: str, keys: str, unit: str, value: str, b: int, seed: int = 0) -> str:
    """Percentile interval of the mean with the md5 draws; columns keys, ci_lo, ci_hi."""
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    lst = "".join(f"{k}, " for k in ks)
    on = " AND ".join([f"s.{k} IS NOT DISTINCT FROM v.{k}" for k in ks] + ["s.idx = v.j"])
    pby = f"PARTITION BY {', '.join(ks)} " if ks else ""
    sel = "".join(f"s.{k}, " for k in ks)
    return f"""
      SELECT {lst}quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (
        SELECT {sel}s.rep, avg(v.x) AS m FROM (
          SELECT {lst}rep, 1 + ('0x' || substr(md5('{seed}|' || rep || '|' || j), 1, 8))::BIGINT % n AS idx
          FROM (SELECT {lst}row_number() OVER ({pby}ORDER BY md5('0|' || {unit}), {unit}) AS j, count(*) OVER ({pby}) AS n FROM {rows}),
               (SELECT unnest(range(1, {b + 1})) AS rep)) s
        JOIN (SELECT {lst}row_number() OVER ({pby}ORDER BY md5('0|' || {unit}), {unit}) AS j, {value} AS x FROM {rows}) v ON {on}
        GROUP BY ALL) GROUP BY ALL"""


def rank_test_sql(rows: str, keys: str, d: str = "d") -> str:
    """Signed-rank sums, z and normal p; columns keys, w_plus, w_minus, n_used, w, z, p_normal."""
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    lst = "".join(f"{k}, " for k in ks)
    pby = ("PARTITION BY " + ", ".join(ks)) if ks else ""
    also = f"{pby}, a" if ks else "PARTITION BY a"
    return f"""
      SELECT *, least(1.0, greatest(0.0, coalesce((((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u)
               * exp(-z * z / 2), 1.0))) AS p_normal FROM (
        SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS u FROM (
          SELECT *, least(w_plus, w_minus) AS w,
                 CASE WHEN n_used > 0 THEN (least(w_plus, w_minus) - n_used * (n_used + 1) / 4.0)
                   / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24.0 - ties / 48.0) END AS z FROM (
            SELECT {lst}coalesce(sum(r) FILTER (dd > 0), 0.0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (dd < 0), 0.0)::DOUBLE AS w_minus,
                   count(*) FILTER (dd <> 0) AS n_used, coalesce(sum(t * t - 1) FILTER (dd <> 0), 0)::DOUBLE AS ties FROM (
              SELECT {lst}dd, t, rk + (t - 1) / 2.0::DOUBLE AS r FROM (
                SELECT {lst}dd, a, rank() OVER ({pby} ORDER BY a NULLS LAST) AS rk, count(*) OVER ({also}) AS t FROM (
                  SELECT {lst}round({d}, 12) AS dd, nullif(abs(round({d}, 12)), 0) AS a FROM {rows}))) GROUP BY ALL)))"""


def paired_sql(diffs: str, keys: str, b: int) -> str:
    """Paired statistics of a block with (keys, subject, va, vb, d)."""
    ks = [k.strip() for k in keys.split(",") if k.strip()]
    lst = "".join(f"{k}, " for k in ks)
    on = lambda t: " AND ".join(f"m.{k} IS NOT DISTINCT FROM {t}.{k}" for k in ks) or "TRUE"
    sel = "".join(f"m.{k}, " for k in ks)
    return f"""
      SELECT {sel}round(m.diff, 6) AS diff, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, m.n, m.n_positive,
             round(m.mean_a, 6) AS mean_a, round(m.mean_b, 6) AS mean_b, r.n_used, round(w_plus, 6) AS w_plus,
             round(w_minus, 6) AS w_minus, round(w, 6) AS w, round(z, 6) AS z, round(p_normal, 6) AS p_normal
      FROM (SELECT {lst}avg(d) AS diff, count(*) AS n, CAST(count(*) FILTER (d > 0) AS BIGINT) AS n_positive,
                   avg(va) AS mean_a, avg(vb) AS mean_b FROM {diffs} GROUP BY ALL) m
      JOIN ({bootstrap_sql(diffs, keys, 'subject', 'd', b)}) c ON {on('c')}
      JOIN ({rank_test_sql(diffs, keys)}) r ON {on('r')}"""
