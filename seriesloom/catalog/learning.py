"""Learner queries: the model contract, spark.ml learners, standardisation, self-training, replay."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from seriesloom.catalog.registry import query, rounded
from seriesloom.catalog.signal import COPY, HALF_TURN, TURNED, draw_sql, turn_sql
from seriesloom.catalog.sqlparts import derive, part, using
from seriesloom.functions import arrays as AR
from seriesloom.operators import augment as AU
from seriesloom.operators import features as FE
from seriesloom.operators import gravity as GR
from seriesloom.operators import gridlearn as G
from seriesloom.operators import learn as L
from seriesloom.operators import scores as S
from seriesloom.operators import stats as ST
from seriesloom.operators import votes as V
from seriesloom.plans import adapt as AP
from seriesloom.plans import cohort as P
from seriesloom.plans import experiment as X
from seriesloom.session import bounded_broadcast, fresh_path, materialize
from seriesloom.sources import adapters as AD

D = P.Design()
TREES, DEPTH = 300, 8  # of the registered forest
AT_ONCE = 4  # cells of the grid whose jobs run side by side


def over_grid(spark, d, learner, windows, name):
    """Run a learner through the contract for every cell: fit on train windows, classify and vote the test windows.

    Cells are parameters; their jobs run side by side and write to one folder each. Adds the sum of the
    probabilities of a series.
    """
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    order = P.nested_set_order(bouts, roles, D)
    train_all = materialize(lambda: P.train_sets(order, D), spark, ("train-sets", d, str(D)))
    test_all = materialize(lambda: P.test_sets(bouts, roles, D), spark, ("test-sets", d, str(D)))
    base = fresh_path(spark, name)

    def one(cell):
        pick = " and ".join(f"{c} = {v}" for c, v in cell.items())
        train = bounded_broadcast(train_all.where(pick).select("series_id"), D.max_train)
        test = test_all.where(pick).select("series_id", "role")
        proba = learner(windows.join(train, "series_id", "left_semi"), windows.join(test, "series_id"))
        sums = proba.groupBy("series_id", "role").agg(F.sum(AR.total(F.col("proba"))).alias("proba_sum"))
        calls = V.vote_series(proba, ["role"], D.n_classes).join(sums, ["series_id", "role"])
        path = f"{base}/{'-'.join(map(str, cell.values()))}"
        calls.withColumns({c: F.lit(v) for c, v in cell.items()}).write.parquet(path)
        return path

    cells = [{"repeat": r, "n_team": n, "k": k} for r in range(1, D.repeats + 1) for n in D.sizes for k in D.ks]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return spark.read.parquet(*pool.map(one, cells))


PROPERTIES = "repeat::INTEGER AS repeat, n_team, k, role, series_id, subject, truth, n_windows, round(n_windows::DOUBLE, 6) AS proba_sum"
COLUMNS = ["repeat", "n_team", "k", "role", "series_id", "subject", "truth", "n_windows", "proba_sum"]


@query("fit_predict", using("preds", f"SELECT {PROPERTIES}, pred FROM preds"))
def fit_predict(spark, d):
    """The contract with the profile learner over the grid: fit_predict(train, test) -> test rows + class probabilities."""
    windows = materialize(lambda: X.cohort_windows(spark, d, X.saved_roles(spark, d, D), D.max_roles), spark, ("cohort-windows", d, str(D)))
    return rounded(over_grid(spark, d, L.profile_learner(D.n_classes), windows, "profile-calls").select(*COLUMNS, "pred"))


def cell_number():
    """Number of a cell (repeat, n_team, k) of the grid."""
    pairs = F.create_map(*[F.lit(x) for i, (n, k) in enumerate((n, k) for n in D.sizes for k in D.ks) for x in (f"{n}-{k}", i)])
    return (F.col("repeat") - 1) * len(D.sizes) * len(D.ks) + F.element_at(pairs, F.concat_ws("-", "n_team", "k"))


def feature_rows(spark, d):
    """Windows with their features, of the drawn subjects."""
    s = X.cohort_signals(spark, d, X.saved_roles(spark, d, D), D.max_roles)
    return materialize(lambda: FE.window_features(FE.sliding_windows(s, X.WINDOW_S, X.OVERLAP, AD.FS), AD.FS), spark, ("features", d, X.WINDOW_S, X.OVERLAP, str(D)))


_fits: dict[tuple, tuple] = {}


def grid_fit(spark, d, kind):
    """(training rows, model) of all cells, fitted once for a session and its parameters."""
    at = (spark.sparkContext.applicationId, d, kind, str(D))
    if at not in _fits:
        train = P.train_sets(P.nested_set_order(AD.vector_bouts(spark, d), X.saved_roles(spark, d, D), D), D)
        rows = G.training_rows(feature_rows(spark, d), FE.feature_names(), train, cell_number())
        fit = {"forest": lambda: G.fit_forest(rows, D.max_conditions, D.n_classes, TREES, DEPTH, seed=3), "logistic": lambda: G.fit_logistic(rows, D.max_conditions, D.n_classes)}[kind]
        _fits[at] = rows, fit()
    return _fits[at]


def ml_result(spark, d, kind):
    """Calls of the test series of every cell: windows are read once, go to the cells that test them, and vote."""

    def run():
        bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
        own = P.test_sets(bouts, roles, D).withColumn("_c", cell_number()).groupBy("series_id", "repeat", "role").agg(F.array_sort(F.collect_list("_c")).alias("cells"))
        proba = G.grid_proba(feature_rows(spark, d).join(own, "series_id"), FE.feature_names(), "cells", grid_fit(spark, d, kind)[1], D.n_classes)
        size = len(D.sizes) * len(D.ks)
        cells = F.array(*[F.struct(F.lit(n).alias("n_team"), F.lit(k).alias("k")) for n in D.sizes for k in D.ks])
        proba = proba.withColumn("_c", F.get(cells, F.col("cell") % size)).select("*", "_c.n_team", "_c.k")
        keys = ["repeat", "n_team", "k", "role"]
        sums = proba.groupBy(*keys, "series_id").agg(F.sum(AR.total(F.col("proba"))).alias("proba_sum"))
        return V.vote_series(proba, keys, D.n_classes).join(sums, [*keys, "series_id"])

    return materialize(run, spark, (f"{kind}-calls", d, TREES, DEPTH, str(D)))


@query("learn_forest")
def learn_forest(spark, d):
    return ml_result(spark, d, "forest")


@query("learn_logistic")
def learn_logistic(spark, d):
    return ml_result(spark, d, "logistic")


@query("learn_forest_properties", using("preds", f"SELECT {PROPERTIES} FROM preds"))
def learn_forest_properties(spark, d):
    """Every test series of every cell is called once, and the probabilities of each of its windows sum to 1."""
    return rounded(ml_result(spark, d, "forest").select(*COLUMNS))


@query("learn_logistic_properties", using("preds", f"SELECT {PROPERTIES} FROM preds"))
def learn_logistic_properties(spark, d):
    """As for the forest."""
    return rounded(ml_result(spark, d, "logistic").select(*COLUMNS))


@query("learn_logistic_optimum", using("train wmeasures", """SELECT repeat::INTEGER AS repeat, n_team, k, count(*) AS n_rows, TRUE AS stationary FROM train t
  JOIN (SELECT DISTINCT series_id, w FROM wmeasures) USING (series_id) GROUP BY ALL""".replace("\n", " ")))
def learn_logistic_optimum(spark, d):
    """Training rows of every cell, and whether the loss has no slope at its coefficients: summed by built-in functions, apart from the fit."""
    rows, fit = grid_fit(spark, d, "logistic")
    counts = G.class_counts(rows, D.max_conditions, D.n_classes)
    weight = G.balanced(counts)
    cells = [(r, n, k) for r in range(1, D.repeats + 1) for n in D.sizes for k in D.ks]
    table = spark.createDataFrame(
        [(i, *cell, fit.mean[i].tolist(), fit.scale[i].tolist(), fit.coef[i].T.tolist(), weight[i].tolist(), int(counts[i].sum())) for i, cell in enumerate(cells)],
        "_c int, repeat int, n_team int, k int, mean array<double>, sd array<double>, coef array<array<double>>, weight array<double>, n_rows long")
    z = F.concat(F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "sd", lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))), F.array(F.lit(1.0)))
    e = rows.select("cls", "x", F.explode("cells").alias("_c")).join(F.broadcast(table), "_c").withColumn("z", z)
    e = e.withColumn("e", F.transform("coef", lambda b: F.exp(AR.total(F.zip_with("z", b, lambda p, q: p * q)))))
    off = F.transform("e", lambda v, c: (v / AR.total(F.col("e")) - (c == F.col("cls")).cast("double")) * F.get("weight", F.col("cls")))
    each = e.select("_c", "z", F.posexplode(off).alias("c", "off")).select("_c", "c", F.posexplode(F.transform("z", lambda v: v * F.col("off"))).alias("j", "g"))
    sums = each.groupBy("_c", "c", "j").agg(F.sum("g").alias("g")).join(F.broadcast(table.select("_c", "repeat", "n_team", "k", "coef", "sd", "n_rows")), "_c")
    slope = F.col("g") + F.when(F.col("j") < F.size("sd"), F.get(F.get("coef", F.col("c")), F.col("j"))).otherwise(0.0)
    return sums.groupBy("repeat", "n_team", "k", "n_rows").agg((F.max(F.abs(slope) / F.col("n_rows")) < 1e-6).alias("stationary"))


@query("learn_forest_training", using("train", """SELECT repeat::INTEGER AS repeat, n_team, k, count(*) AS n_series, TRUE AS learned FROM train GROUP BY ALL"""))
def learn_forest_training(spark, d):
    """Training series of every cell, and whether its forest calls nine in ten of them right."""
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    train = P.train_sets(P.nested_set_order(bouts, roles, D), D)
    own = train.select("series_id", cell_number().alias("_c")).groupBy("series_id").agg(F.array_sort(F.collect_list("_c")).alias("cells"))
    proba = G.grid_proba(feature_rows(spark, d).join(own, "series_id"), FE.feature_names(), "cells", grid_fit(spark, d, "forest")[1], D.n_classes)
    calls = V.vote_series(proba, ["cell"], D.n_classes)
    cells = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(n).alias("n_team"), F.lit(k).alias("k")) for r in range(1, D.repeats + 1) for n in D.sizes for k in D.ks])
    named = calls.withColumn("_c", F.get(cells, F.col("cell"))).select("*", "_c.repeat", "_c.n_team", "_c.k")
    return named.groupBy("repeat", "n_team", "k").agg(F.count(F.lit(1)).alias("n_series"), (F.avg((F.col("pred") == F.col("truth")).cast("double")) >= 0.9).alias("learned"))


def measure_columns(spark, d):
    w = X.cohort_windows(spark, d)
    return w.select("series_id", "subject", "period_order", "w", *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(L.MEASURES)])


STD_COLS = "x_mean y_mean z_mean mag_mean x_std y_std z_std mag_std".split()
part("wwide", ("wmeasures",), "SELECT series_id, subject, period_order, w, " + ", ".join(f"max(m) FILTER (mi = {i}) AS {c}" for i, c in enumerate(STD_COLS)) + " FROM wmeasures GROUP BY ALL")


def _std_sql(stats: str, on: str) -> str:
    cols = ", ".join(f"round((a.{c} - s.m_{c}) / (s.s_{c} + 1e-6), 5) AS {c}" for c in STD_COLS)
    return f"SELECT a.series_id, a.w::INTEGER AS w, {cols} FROM wwide a JOIN ({stats}) s ON {on}"


_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in STD_COLS)


@query("standardize", using("wwide train", f"""SELECT t.repeat::INTEGER AS repeat, t.n_team, t.k, a.series_id, a.w::INTEGER AS w, {', '.join(f"round((a.{c} - s.m_{c}) / (s.s_{c} + 1e-6), 5) AS {c}" for c in STD_COLS)}
  FROM train t JOIN wwide a USING (series_id) JOIN (SELECT repeat, n_team, k, {_STATS} FROM train JOIN wwide USING (series_id) GROUP BY ALL) s ON (s.repeat, s.n_team, s.k) = (t.repeat, t.n_team, t.k)""".replace("\n", " ")))
def standardize(spark, d):
    """Team scope: in every cell, mean and SD of its training windows."""
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    train = P.train_sets(P.nested_set_order(bouts, roles, D), D).select(*X.COND, "series_id")
    w = measure_columns(spark, d).join(bounded_broadcast(train, D.max_train), "series_id")
    z = L.standardize(w, w, X.COND, STD_COLS)
    return z.select(*X.COND, "series_id", "w", *[F.round(c, 5).alias(c) for c in STD_COLS])


@query("standardize_subject", using("wwide", _std_sql(f"SELECT subject, {_STATS} FROM wwide WHERE period_order = 1 GROUP BY ALL", "s.subject = a.subject")))
def standardize_subject(spark, d):
    """Label-free calibration: each subject's own first-period windows set mean and SD."""
    w = measure_columns(spark, d)
    z = L.standardize(w, w.where("period_order = 1"), ["subject"], STD_COLS)
    return z.select("series_id", "w", *[F.round(c, 5).alias(c) for c in STD_COLS])


# --- self-training ---------------------------------------------------------------------------------

part("labeled", ("train",), "SELECT repeat, series_id FROM train WHERE n_team = 2 AND k = 2")
part("unlabeled", ("pool",), "SELECT repeat, series_id FROM vbouts JOIN pool r USING (subject) WHERE role = 'candidate' AND r.rank > 2 AND period_order = 1")


def _round_parts(i: int, fraction: float, x: str = "") -> None:
    """SQL of round i; ``x`` names another chain with unlabeled series of its own."""
    src = "SELECT t.repeat, s.cls, mi, m FROM labeled t JOIN smeasures s USING (series_id)"
    if i > 1:
        src += f" UNION ALL SELECT t.repeat, t.pred, mi, m FROM kept{i - 1}{x} t JOIN smeasures s USING (series_id)"
    needs = ("labeled", f"unlabeled{x}", "smeasures", "wmeasures") + ((f"kept{i - 1}{x}",) if i > 1 else ())
    part(f"fit{i}{x}", needs, f"SELECT repeat, cls, mi, quantile_cont(m, 0.5) AS mu, var_samp(m) AS v FROM ({src}) GROUP BY ALL")
    part(f"scale{i}{x}", (f"fit{i}{x}",), f"SELECT repeat, mi, sqrt(avg(v)) + 1e-9 AS scale FROM fit{i}{x} GROUP BY ALL")
    part(f"open{i}{x}", (f"scale{i}{x}",), f"""
      SELECT repeat, series_id, truth, c, avg(q / t) AS p FROM (SELECT *, sum(q) OVER (PARTITION BY repeat, series_id, w) AS t FROM (
        SELECT u.repeat, u.series_id, w.cls AS truth, w.w, f.cls AS c, 1 / (1 + sum(((w.m - f.mu) / s.scale) ** 2)) AS q FROM unlabeled{x} u JOIN wmeasures w USING (series_id)
        JOIN fit{i}{x} f ON (f.repeat, f.mi) = (u.repeat, w.mi) JOIN scale{i}{x} s ON (s.repeat, s.mi) = (u.repeat, w.mi) GROUP BY ALL)) GROUP BY ALL""")
    part(f"call{i}{x}", (f"open{i}{x}",), f"SELECT repeat, series_id, truth, arg_max(c, (p, -c)) AS pred, max(p) AS conf FROM open{i}{x} GROUP BY ALL")
    part(f"kept{i}{x}", (f"call{i}{x}",), f"""SELECT repeat, series_id, truth, pred FROM (SELECT *, row_number() OVER (PARTITION BY repeat, pred ORDER BY conf DESC, series_id) AS r,
      count(*) OVER (PARTITION BY repeat, pred) AS n FROM call{i}{x}) WHERE r <= ceil({fraction} * n)""")


part("unlabelednew", ("unlabeled", "roles"), """SELECT * FROM unlabeled UNION ALL
  SELECT repeat, series_id FROM vbouts JOIN roles r USING (subject) WHERE r.role = 'new' AND period_order = 1""")
for _x in ("", "new"):
    _round_parts(1, 0.5, _x)
    _round_parts(2, 0.8, _x)


@query("self_train", using("kept2", " UNION ALL ".join(f"""SELECT a.repeat::INTEGER AS repeat, {i} AS round, {f}::DOUBLE AS fraction, n_unlabeled, n_pseudo, round(acc_all, 6) AS acc_all, round(acc_kept, 6) AS acc_kept
  FROM (SELECT repeat, count(*) AS n_unlabeled, avg((pred = truth)::INTEGER) AS acc_all FROM call{i} GROUP BY ALL) a
  JOIN (SELECT repeat, count(*) AS n_pseudo, avg((pred = truth)::INTEGER) AS acc_kept FROM kept{i} GROUP BY ALL) b USING (repeat)""" for i, f in ((1, 0.5), (2, 0.8)))))
def self_train(spark, d):
    """Two rounds with the profile learner; labeled = team of two, unlabeled = the other candidates' first-period series."""
    return rounded(self_training(spark, d).diagnostics.drop("with_new"))


_trained: dict[tuple, tuple] = {}


def all_windows(spark, d):
    """Windows of all subjects with their measures, written once."""
    return materialize(lambda: X.cohort_windows(spark, d), spark, ("windows", d, X.WINDOW_S, X.OVERLAP))


def self_training(spark, d, with_new=False):
    """Two rounds of self-training by (repeat, with_new), trained once for a session.

    ``with_new``: beside the plain chain of rounds, one whose unlabeled series are also the first-period series of the new subjects.
    """
    at = (spark.sparkContext.applicationId, d, str(D), with_new)
    if at not in _trained:
        bouts = AD.vector_bouts(spark, d)
        roles = X.saved_roles(spark, d, D)
        chains = F.array(*map(F.lit, (False, True) if with_new else (False,)))
        labeled = P.train_sets(P.nested_set_order(bouts, roles, D), D).where("n_team = 2 and k = 2").select("repeat", F.explode(chains).alias("with_new"), "series_id")
        rest = X.pool_roles(spark, d, D).where("role = 'new' or rank > 2").select("repeat", "subject", "role", F.explode(chains).alias("with_new"))
        rest = rest.where("role = 'candidate' or with_new").drop("role")
        unlabeled = bouts.where("period_order = 1").join(rest, "subject").select("repeat", "with_new", "series_id")
        series = X.packed_windows(X.cohort_signals(spark, d))
        _trained[at] = AP.self_train(spark, series, labeled, unlabeled, ["repeat", "with_new"], (0.5, 0.8), D.n_classes, D.repeats * (1 + with_new))
    return _trained[at]


# --- replay ----------------------------------------------------------------------------------------

part("rteam", ("train", "wpoints"), "SELECT t.repeat, t.cls, w.series_id, w.w FROM (SELECT DISTINCT series_id, w FROM wpoints) w JOIN train t USING (series_id) WHERE n_team = 4 AND k = 2")
part("rown", ("roles", "wpoints"), "SELECT DISTINCT r.repeat, w.subject, w.cls, w.series_id, w.w FROM wpoints w JOIN roles r ON r.subject = w.subject AND role = 'new' WHERE period_order = 1 AND cls IN (0, 6)")
part("rslots", ("roles",), """SELECT repeat, subject, slot, CAST(('0x' || substr(md5('9|' || repeat || '|' || subject || '|' || slot || '|class'), 1, 8))::BIGINT % 10 AS INTEGER) AS cls,
  ('0x' || substr(md5('9|' || repeat || '|' || subject || '|' || slot || '|source'), 1, 8))::BIGINT / 4294967296.0 AS u,
  ('0x' || substr(md5('9|' || repeat || '|' || subject || '|' || slot || '|row'), 1, 8))::BIGINT AS i FROM roles, (SELECT unnest(range(1, 201)) AS slot) WHERE role = 'new'""")


@query("balanced_replay_sample", using("rteam rown rslots", """, o AS (SELECT *, row_number() OVER (PARTITION BY repeat, subject, cls ORDER BY md5('9|' || series_id || '|' || w), series_id, w) AS j,
    count(*) OVER (PARTITION BY repeat, subject, cls) AS n FROM rown),
  t AS (SELECT *, row_number() OVER (PARTITION BY repeat, cls ORDER BY md5('9|' || series_id || '|' || w), series_id, w) AS j, count(*) OVER (PARTITION BY repeat, cls) AS n FROM rteam),
  s AS (SELECT s.*, q.n AS own_n, q.n IS NOT NULL AND u < 0.5 AS own FROM rslots s LEFT JOIN (SELECT DISTINCT repeat, subject, cls, n FROM o) q USING (repeat, subject, cls))
  SELECT s.repeat::INTEGER AS repeat, s.subject, slot::INTEGER AS slot, s.cls, 'own' AS source, o.series_id, o.w::INTEGER AS w FROM s JOIN o ON (o.repeat, o.subject, o.cls) = (s.repeat, s.subject, s.cls) AND o.j = 1 + i % own_n WHERE own
  UNION ALL SELECT s.repeat::INTEGER, s.subject, slot::INTEGER, s.cls, 'team', t.series_id, t.w::INTEGER FROM s JOIN t ON (t.repeat, t.cls) = (s.repeat, s.cls) AND t.j = 1 + i % t.n WHERE NOT own""".replace("\n", " ")))
def balanced_replay_sample(spark, d):
    bouts = AD.vector_bouts(spark, d)
    roles = X.saved_roles(spark, d, D)
    train = P.train_sets(P.nested_set_order(bouts, roles, D), D).where("n_team = 4 and k = 2").select("repeat", "cls", "series_id")
    windows = FE.sliding_windows(X.cohort_signals(spark, d, roles, D.max_roles), X.WINDOW_S, X.OVERLAP, AD.FS).select("series_id", "subject", "cls", "period_order", "w")
    who = roles.where("role = 'new'").select("repeat", "subject")
    own = windows.where("period_order = 1 and cls in (0, 6)").join(bounded_broadcast(who, D.max_roles), "subject").select("repeat", "subject", "cls", "series_id", "w")
    team = windows.select("series_id", "w").join(bounded_broadcast(train, D.max_train), "series_id").select("repeat", "cls", "series_id", "w")
    return AP.replay_draws(own, team, who, ["repeat"], 200, D.n_classes, 9)


# --- the same plan on other signals ------------------------------------------------------------------

SUMMARY = ["n_team", "k", "role"]


def summary_sql(scores: str, **columns) -> str:
    extra = "".join(f"{v!r} AS {k}, " for k, v in columns.items())
    return (f"SELECT {extra}n_team, k, role, round(avg(f), 6) AS macro_f1, round(avg(a), 6) AS accuracy, count(*) AS n_units FROM "
            f"(SELECT n_team, k, role, subject, avg(macro_f1) AS f, avg(accuracy) AS a FROM {scores} GROUP BY ALL) GROUP BY ALL")


def summary(scores):
    """Mean per subject first, then across subjects."""
    u = scores.groupBy(*SUMMARY, "subject").agg(F.avg("macro_f1").alias("f"), F.avg("accuracy").alias("a"))
    return rounded(u.groupBy(*SUMMARY).agg(F.avg("f").alias("macro_f1"), F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("n_units")))


_LENGTH = "sqrt({0}0 * {0}0 + {0}1 * {0}1 + {0}2 * {0}2)"
_REST = {f"r{c}": f"v{c} - g{c}" for c in range(3)}
part("parts", ("axes",), f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in _REST.items())} FROM axes")
_VALUES = {"full": "v", "gravity": "g", "motion": "r"}
_SCORES = {}
for _name in GR.VARIANTS:
    _x = _VALUES.get(_name, "v")
    _channels = [f"SELECT series_id, s, {c} AS c, {_x}{c} AS v FROM parts" for c in range(3)] if _name != "magnitude" else []
    _channels.append(f"SELECT series_id, s, {len(_channels)} AS c, {_LENGTH.format(_x)} AS v FROM parts")
    _SCORES[_name] = derive(f"_{_name}", "wpoints", f"""
      SELECT p.series_id, b.subject, b.cls, b.period_order, w, w * 2 / 8.0::DOUBLE AS t0_s, c, s - w * 2 AS i, v FROM ({' UNION ALL '.join(_channels)}) p
      JOIN vbouts b USING (series_id), (SELECT unnest(range(5)) AS w) WHERE s >= w * 2 AND s < w * 2 + 8""", ("parts", "vbouts"))


@query("signal_ablation", using(" ".join(_SCORES.values()), " UNION ALL ".join(summary_sql(t, variant=v) for v, t in _SCORES.items())))
def signal_ablation(spark, d):
    """Scores of the same plan on the full signal, its slow part, its motion, and its magnitude alone."""
    signals = X.cohort_signals(spark, d, X.saved_roles(spark, d, D), D.max_roles)
    out = None
    for variant in GR.VARIANTS:
        windows = X.windows_of(GR.split_variant(signals, variant, AD.FS))
        one = summary(X.scores_of(spark, d, windows, D, 2 if variant == "magnitude" else len(L.MEASURES))).withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return out


_FREE = derive("_free", "wmeasures", """
  SELECT w.* EXCLUDE (m), (m - mu) / (sd + 1e-6) AS m FROM wmeasures w
  JOIN (SELECT subject, mi, avg(m) AS mu, stddev_pop(m) AS sd FROM wmeasures WHERE period_order = 1 GROUP BY ALL) USING (subject, mi)""", ("wmeasures",))


@query("label_free_calibration", using(_FREE, summary_sql(_FREE)))
def label_free_calibration(spark, d):
    """Scores of the same plan after every subject's measures are set by its own first-period windows, without labels."""
    windows = X.cohort_windows(spark, d, X.saved_roles(spark, d, D), D.max_roles)
    return summary(X.scores_of(spark, d, L.calibrate_subject(windows, windows.where("period_order = 1"))))


# --- training on simulated copies ------------------------------------------------------------------------

COPIES = 2  # of every training series
_MOVED = f"""WITH d AS (SELECT *, 0.8 + 0.4 * {draw_sql(COPY, 'tempo')} AS tempo, 0.8 + 0.4 * {draw_sql(COPY, 'intensity')} AS k, {turn_sql(COPY, -HALF_TURN, HALF_TURN)}
    FROM (SELECT DISTINCT series_id FROM train), (SELECT unnest(range({COPIES})) AS copy)),
  e AS (SELECT *, greatest(2, CAST(round_even(16 / tempo, 0) AS INTEGER)) - 1 AS steps FROM d), g AS (SELECT *, unnest(range(steps + 1)) AS s FROM e),
  q AS (SELECT *, s * 15.0::DOUBLE / steps AS pos FROM g),
  b AS (SELECT q.*, {', '.join(f'a.g{c} + k * (a.v{c} - a.g{c}) + (pos - floor(pos)) * (z.g{c} + k * (z.v{c} - z.g{c}) - a.g{c} - k * (a.v{c} - a.g{c})) AS b{c}' for c in range(3))}
    FROM q JOIN axes a ON a.series_id = q.series_id AND a.s = floor(pos) JOIN axes z ON z.series_id = q.series_id AND z.s = least(15, floor(pos) + 1))
  SELECT -(series_id * {COPIES} + copy + 1) AS series_id, steps + 1 AS n, s, [{', '.join(TURNED)}, sqrt(b0 * b0 + b1 * b1 + b2 * b2)] AS v FROM b"""
part("copied", ("axes", "train"), _MOVED)
part("smeasures_aug", ("copied", "smeasures"), """SELECT series_id, mi, m FROM smeasures UNION ALL
  SELECT series_id, mi, avg(m) AS m FROM (SELECT series_id, w, unnest([c, c + 4]) AS mi, unnest([a, sd]) AS m FROM (
    SELECT series_id, w, c, avg(v[c + 1]) AS a, stddev_pop(v[c + 1]) AS sd FROM copied, (SELECT unnest(range(20)) AS w), (SELECT unnest(range(4)) AS c)
    WHERE 2 * w + 8 <= n AND s >= 2 * w AND s < 2 * w + 8 GROUP BY ALL)) GROUP BY ALL""")
part("train_aug", ("train",), f"""SELECT repeat, n_team, k, cls, series_id FROM train UNION ALL
  SELECT repeat, n_team, k, cls, -(series_id * {COPIES} + copy + 1) FROM train, (SELECT unnest(range({COPIES})) AS copy)""")
_AUG = derive("_aug", "profiles", anew=("train", "smeasures"))


@query("simulated_training", using(f"{_AUG} scores", f""", a AS ({summary_sql(_AUG)}), s AS ({summary_sql("scores")}),
  mono AS (SELECT k, n_team, max(macro_f1) OVER (PARTITION BY k ORDER BY n_team) AS f FROM s WHERE role = 'new'),
  seg AS (SELECT k, n_team AS x0, f AS f0, lead(n_team) OVER (PARTITION BY k ORDER BY n_team) AS x1, lead(f) OVER (PARTITION BY k ORDER BY n_team) AS f1 FROM mono)
  SELECT a.n_team, a.k, a.macro_f1, s.macro_f1 AS plain_f1, a.n_units, round((SELECT CASE WHEN x1 IS NOT NULL THEN x0 + (a.macro_f1 - f0) / (f1 - f0) * (x1 - x0) WHEN a.macro_f1 = f0 THEN x0::DOUBLE END
    FROM seg WHERE seg.k = a.k AND a.macro_f1 >= f0 AND (x1 IS NULL OR a.macro_f1 < f1) ORDER BY x0 DESC LIMIT 1), 6) AS equivalent_x
  FROM a JOIN s ON (s.n_team, s.k, s.role) = (a.n_team, a.k, a.role) WHERE a.role = 'new'""".replace("\n", " ")))
def simulated_training(spark, d):
    """Scores of the new subjects when every training series comes with simulated copies, and the team size that is worth as much without them."""
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    train = P.train_sets(P.nested_set_order(bouts, roles, D), D)
    signals = X.cohort_signals(spark, d, roles, D.max_roles)
    own = signals.join(bounded_broadcast(train.select("series_id").distinct(), D.max_train), "series_id", "left_semi")
    number = -(F.col("series_id") * COPIES + F.col("copy") + 1)  # a series id of its own
    copies = AU.augment_retime_scale(own, COPIES, 11, AD.FS, max_degrees=15.0).withColumn("series_id", number).select(*signals.columns)
    both = train.unionByName(AU.with_copies(train, COPIES).withColumn("series_id", number).drop("copy"))
    moved = materialize(lambda: X.windows_of(copies), spark, ("moved-windows", d, COPIES, str(D)))
    windows = all_windows(spark, d).unionByName(moved)
    simulated = summary(X.scores_of(spark, d, windows, train=both, test=P.test_sets(bouts, roles, D))).where("role = 'new'")
    plain = summary(X.grid_scores(spark, d)).where("role = 'new'").select("n_team", "k", F.col("macro_f1").alias("plain_f1"))
    worth = ST.equivalent_x(simulated, plain.withColumnRenamed("n_team", "x"), ["k"], "x", "plain_f1", "macro_f1")
    return rounded(worth.join(plain, ["n_team", "k"]).select("n_team", "k", "macro_f1", "plain_f1", "n_units", "equivalent_x"))


SPLITS = ((1, 4), (2, 2), (4, 1))  # subjects x sets of each class, one budget

part("train_split", ("roles",), " UNION ALL ".join(f"""SELECT repeat, {n} AS n_team, {k} AS k, subject, cls, series_id FROM (
  SELECT repeat, subject, cls, series_id, row_number() OVER (PARTITION BY repeat, subject, cls ORDER BY period_order > 1,
    CASE WHEN period_order = 1 THEN md5('7|' || repeat || '|' || series_id) END NULLS FIRST, series_id) AS set_rank
  FROM vbouts JOIN roles r USING (subject) WHERE role = 'candidate' AND r.rank <= {n}) WHERE set_rank <= {k}""" for n, k in SPLITS))
part("test_split", ("roles",), f"""SELECT repeat, n_team, k, 'new' AS role, subject, cls, series_id FROM vbouts JOIN roles r USING (subject),
  (SELECT * FROM (VALUES {', '.join(map(str, SPLITS))}) t(n_team, k)) WHERE period_order > 1 AND role = 'new'""")
_SPLIT = derive("_split", "profiles", anew=("train", "test"))


@query("deep_against_broad", using(_SPLIT, summary_sql(_SPLIT)))
def deep_against_broad(spark, d):
    """Few subjects with many sets, across their periods, against many subjects with few: scores of the new subjects."""
    bouts, roles = AD.vector_bouts(spark, d), X.saved_roles(spark, d, D)
    train, cells = None, F.array(*[F.struct(F.lit(n).alias("n_team"), F.lit(k).alias("k")) for n, k in SPLITS])
    for n, k in SPLITS:
        sets = P.depth_sets(bouts, roles, D, n, k, ["series_id"]).select("repeat", F.lit(n).alias("n_team"), F.lit(k).alias("k"), "subject", "cls", "series_id")
        train = sets if train is None else train.unionByName(sets)
    new = roles.where("role = 'new'").select("repeat", "subject", "role", F.explode(cells).alias("_c")).select("*", "_c.n_team", "_c.k").drop("_c")
    test = bouts.where("period_order > 1").select("series_id", "subject").join(bounded_broadcast(new, D.max_roles * len(SPLITS)), "subject")
    windows = X.cohort_windows(spark, d, roles, D.max_roles)
    return summary(X.scores_of(spark, d, windows, train=train, test=test))


# --- self-training, scored -----------------------------------------------------------------------------

# team only; with pseudo-labels of the other candidates; all candidates labelled; with pseudo-labels of the new subjects' first period as well
CONDITIONS = ("supervised", "self-trained", "ceiling", "self-trained on new")

part("train_ssl", ("labeled", "unlabeled", "kept2", "kept2new"), """SELECT repeat, n_team, 2 AS k, cls, series_id FROM (SELECT repeat, series_id FROM labeled) JOIN vbouts USING (series_id), (SELECT unnest([1, 2, 3, 4]) AS n_team)
  UNION ALL SELECT repeat, 4, 2, pred, series_id FROM kept2new
  UNION ALL SELECT repeat, 2, 2, pred, series_id FROM kept2
  UNION ALL SELECT repeat, 3, 2, cls, series_id FROM unlabeled JOIN vbouts USING (series_id)""")
part("test_ssl", ("roles",), """SELECT repeat, n_team, 2 AS k, 'new' AS role, subject, cls, series_id FROM vbouts JOIN roles r USING (subject), (SELECT unnest([1, 2, 3, 4]) AS n_team)
  WHERE period_order > 1 AND role = 'new'""")
_SSL = derive("_ssl", "profiles", anew=("train", "test"))


@query("self_train_scores", using(_SSL, f"SELECT CASE n_team {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(CONDITIONS, 1))} END AS condition, macro_f1, accuracy, n_units FROM ({summary_sql(_SSL)})"))
def self_train_scores(spark, d):
    """Self-trained models beside the team alone and beside a model with all true labels, on the new subjects' later periods."""
    roles, done = X.saved_roles(spark, d, D), self_training(spark, d, with_new=True)

    def sets(df, cls, *codes):
        return df.select("repeat", F.explode(F.array(*map(F.lit, codes))).alias("n_team"), F.lit(2).alias("k"), F.col(cls).alias("cls"), "m")

    train = sets(done.known.where("not with_new"), "cls", 1, 2, 3).unionByName(sets(done.known.where("with_new"), "cls", 4)).unionByName(
        sets(done.kept.where("not with_new"), "pred", 2)).unionByName(sets(done.calls.where("not with_new"), "truth", 3)).unionByName(sets(done.kept.where("with_new"), "pred", 4))
    conditions = D.repeats * len(CONDITIONS)
    profiles = AP.profiles_table(train, X.COND)
    codes = F.explode(F.array(*[F.lit(i + 1) for i in range(len(CONDITIONS))]))
    new = roles.where("role = 'new'").select("repeat", "subject", "role", codes.alias("n_team"), F.lit(2).alias("k"))
    # the new subjects' later periods only, found by a broadcast before they are windowed
    windows = X.cohort_windows(spark, d, roles.where("role = 'new'"), D.max_roles).where("period_order > 1")
    proba = L.profile_proba(windows.join(bounded_broadcast(new, len(CONDITIONS) * D.max_roles), "subject"), profiles, X.COND, D.n_classes, conditions)
    scores = S.subject_scores(V.vote_series(proba, [*X.COND, "role"], D.n_classes), [*X.COND, "role", "subject"], D.n_classes)
    names = F.array(*[F.lit(c) for c in CONDITIONS])
    return summary(scores).select(F.element_at(names, F.col("n_team")).alias("condition"), "macro_f1", "accuracy", "n_units")
