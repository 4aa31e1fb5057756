"""Named training conditions: calibration batteries per new subject, and extra sets at equal budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import vocabulary as V
from seriesloom.functions.hashing import draw_key
from seriesloom.functions.ordering import first_k, null_safe_join, value_ranks
from seriesloom.operators import learn as L
from seriesloom.plans import cohort as P
from seriesloom.plans.experiment import cohort_windows, saved_roles
from seriesloom.session import bounded_broadcast, fresh_path, materialize
from seriesloom.sources import adapters as AD

N_RANDOM = 2


def battery_table(roles: DataFrame, design: P.Design) -> DataFrame:
    """Per new subject: no battery, the two named class pairs, two seeded random pairs, and all classes."""
    named = [(n, list(c)) for n, c in V.NAMED_BATTERIES.items()]
    pairs = [[a, b] for a in range(design.n_classes) for b in range(a + 1, design.n_classes) if [a, b] not in [c for _, c in named]]
    new = roles.where("role = 'new'").select("repeat", "subject")
    lit = lambda cs: F.array(*[F.lit(c) for c in cs]).cast("array<int>")
    fixed = [F.struct(F.lit("none").alias("battery"), lit([]).alias("classes")), F.struct(F.lit("all").alias("battery"), lit(range(design.n_classes)).alias("classes"))]
    fixed += [F.struct(F.lit(n).alias("battery"), lit(c).alias("classes")) for n, c in named]
    base = new.select("repeat", "subject", F.explode(F.array(*fixed)).alias("b")).select("repeat", "subject", "b.*")
    draw = (new.withColumn("classes", F.explode(F.array(*[lit(c) for c in pairs])))
            .withColumn("_o", draw_key(design.seed, "repeat", "subject", F.array_join("classes", ","))))
    rand = first_k(draw, ["repeat", "subject"], [F.col("_o")], N_RANDOM, "j")
    return base.unionByName(rand.select("repeat", "subject", F.concat(F.lit("random"), F.col("j").cast("string")).alias("battery"), "classes"))


def battery_training(bouts: DataFrame, roles: DataFrame, design: P.Design, n_team: int, k: int) -> DataFrame:
    """Training series per (repeat, new subject, battery): the team's, plus the subject's own battery sets."""
    table = battery_table(roles, design)
    team = P.nested_set_order(bouts, roles, design, k).where(F.col("team_rank") <= n_team).select("repeat", "series_id")
    of_team = table.select("repeat", "subject", "battery").join(team, "repeat")
    own = (bouts.where("period_order = 1").select("series_id", "subject", "cls")
           .join(bounded_broadcast(roles.where("role = 'new'").select("repeat", "subject"), design.max_roles), "subject")
           .withColumn("_o", draw_key(design.seed, "repeat", "series_id")))
    own = first_k(own, ["repeat", "subject", "cls"], [F.col("_o"), F.col("series_id")], k, "set_rank")
    of_own = own.join(table, ["repeat", "subject"]).where(F.array_contains("classes", F.col("cls")))
    return of_team.unionByName(of_own.select("repeat", "subject", "battery", "series_id"))


def battery_predictions(spark: SparkSession, sf_dir: str, design: P.Design = P.Design(), n_team: int = 4, k: int = 2) -> DataFrame:
    """Calls on every later series of each new subject under each battery; the same test series for all."""

    def run():
        bouts = AD.vector_bouts(spark, sf_dir)
        roles = saved_roles(spark, sf_dir, design)
        train = battery_training(bouts, roles, design, n_team, k).withColumnRenamed("subject", "for_subject")
        n_cond = design.repeats * design.n_new * (4 + N_RANDOM)
        train = bounded_broadcast(train, n_cond * (n_team + 1) * k * design.n_classes)
        series = L.series_mean(cohort_windows(spark, sf_dir, roles, design.max_roles))
        keys = ["repeat", "for_subject", "battery"]
        profiles = L.fit_profiles(series.join(train, "series_id"), keys)
        test = (bouts.where("period_order > 1").select("series_id").join(series, "series_id")
                .withColumn("for_subject", F.col("subject")))
        # every later series meets the conditions of its own subject only
        cond = profiles.join(battery_table(roles, design).withColumnRenamed("subject", "for_subject"), keys)
        rows = test.join(bounded_broadcast(cond, n_cond), "for_subject").withColumn("_d", L.profile_distances())
        best = F.array_min(F.transform("_d", lambda r: F.struct(r["d"].alias("d"), r["cls"].alias("cls"))))
        return rows.select("repeat", "subject", "battery", F.array_join("classes", ",").alias("battery_classes"), "series_id",
                           F.col("cls").alias("truth"), best["cls"].alias("pred"))

    return materialize(run, spark, ("battery", sf_dir, str(design), n_team, k))


def extra_training(bouts: DataFrame, roles: DataFrame, design: P.Design, n_team: int, targeted: list[int], n_broad: int) -> DataFrame:
    """base / targeted / random / broad / k2 training series per repeat, labelled by condition."""
    order = P.nested_set_order(bouts, roles, design, 2)
    inside = F.col("team_rank") <= n_team
    # random control: as many classes as targeted ones, drawn per repeat
    rand = (roles.select("repeat").distinct().withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(design.n_classes - 1))))
            .withColumn("_o", draw_key(design.seed, "repeat", "cls")))
    rand = first_k(rand, ["repeat"], [F.col("_o")], len(targeted), "j").select("repeat", "cls", F.lit(2).alias("allowed"))
    randomly = order.join(bounded_broadcast(rand, design.repeats * design.n_classes), ["repeat", "cls"], "left").where(
        inside & (F.col("set_rank") <= F.coalesce("allowed", F.lit(1))))
    parts = {"base": order.where(inside & (F.col("set_rank") <= 1)), "targeted": P.extra_sets(order, n_team, targeted),
             "random": randomly, "broad": order.where((F.col("team_rank") <= n_broad) & (F.col("set_rank") <= 1)),
             "k2": order.where(inside & (F.col("set_rank") <= 2))}
    out = None
    for name, d in parts.items():
        d = d.select("repeat", F.lit(name).alias("condition"), "series_id")
        out = d if out is None else out.unionByName(d)
    return out


def extra_predictions(spark: SparkSession, sf_dir: str, design: P.Design = P.Design(), n_team: int = 4,
                      targeted: tuple[int, ...] = (0, 1, 2), n_broad: int = 5) -> DataFrame:
    """Calls of the new subjects' later series under every extra-set condition."""

    def run():
        bouts = AD.vector_bouts(spark, sf_dir)
        roles = saved_roles(spark, sf_dir, design)
        train = extra_training(bouts, roles, design, n_team, list(targeted), n_broad)
        series = L.series_mean(cohort_windows(spark, sf_dir, roles, design.max_roles))
        keys = ["repeat", "condition"]
        profiles = L.fit_profiles(series.join(bounded_broadcast(train, design.repeats * 5 * n_broad * 2 * design.n_classes), "series_id"), keys)
        new = roles.where("role = 'new'").select("repeat", "subject")
        test = series.join(bounded_broadcast(new, design.max_roles), "subject").join(
            bouts.where("period_order > 1").select("series_id"), "series_id", "left_semi")
        out = L.nearest_profile(test, profiles, ["repeat"], design.repeats * 5)
        return out.select("repeat", "condition", "subject", "series_id", F.col("cls").alias("truth"), "pred")

    return materialize(run, spark, ("extra", sf_dir, str(design), n_team, targeted, n_broad))


def fold_profiles(rows: DataFrame, k_folds: int) -> DataFrame:
    """(cls, out, mi, mu, var): median and sample variance of each measure over the rows of a class outside fold ``out``.

    ``rows`` has (cls, fold, m). Values are counted by fold once; the ranks outside a fold are those of all rows less
    those of the fold, carried along as further running counts of one pass.
    """
    long = rows.select("cls", "fold", F.posexplode("m").alias("mi", "v"))
    outside = {f"o{f}": F.count(F.when(F.col("fold") != f, F.col("v"))) for f in range(k_folds)}
    r = value_ranks(long, ["cls", "mi"], "v", extra=outside, running=list(outside))
    found = []
    for o in outside:
        n, before, total = F.col(o), F.col(f"{o}_before"), F.col(f"{o}_total")
        for end, index in (("lo", F.floor((total - 1) / 2)), ("hi", F.ceil((total - 1) / 2))):
            found.append(F.max(F.when((before <= index) & (index < before + n), F.col("v"))).alias(f"{end}_{o}"))
    medians = r.groupBy("cls", "mi").agg(*found)
    spread = long.groupBy("cls", "mi").agg(*[F.var_samp(F.when(F.col("fold") != f, F.col("v"))).alias(f"var_o{f}") for f in range(k_folds)])
    both = null_safe_join(medians, spread, ["cls", "mi"])
    per = F.array(*[F.struct(F.lit(f).alias("out"), ((F.col(f"lo_o{f}") + F.col(f"hi_o{f}")) / 2).alias("mu"), F.col(f"var_o{f}").alias("var")) for f in range(k_folds)])
    return both.select("cls", "mi", F.explode(per).alias("_o")).select("cls", "_o.out", "mi", "_o.mu", "_o.var").where("mu IS NOT NULL")


def pair_screen(spark: SparkSession, sf_dir: str, k_folds: int = 5, n_measures: int = len(L.MEASURES)) -> DataFrame:
    """Every class pair under subject-grouped cross-validation with the profile learner, in one job.

    A class profile depends on the class and the left-out fold only, so it is fitted once and shared by all
    pairs. Its medians come from counts of each value by fold: the values of the other folds are all less the
    fold's own, so every measure of a series is ranked once, through the split ranks. A series is judged for all
    pairs of its class in its own row; only counts per (pair, fold, truth, call) leave the scoring stage.
    """
    from seriesloom.operators.joins import class_pairs

    rows = materialize(lambda: L.series_mean(cohort_windows(spark, sf_dir)), spark, ("series", sf_dir))
    folds = P.group_kfold(rows, k_folds).select("subject", "fold")
    rows = rows.join(folds, "subject")
    path = fresh_path(spark, "pair-rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    n_classes = rows.select("cls").distinct().count()  # measured: it bounds what is broadcast below
    # one row per left-out fold: classes x measures
    model = fold_profiles(rows, k_folds).groupBy("out", "cls").agg(F.array_sort(F.collect_list(F.struct("mi", "mu", "var"))).alias("p"))
    model = model.groupBy("out").agg(F.map_from_entries(F.collect_list(F.struct("cls", "p"))).alias("model"))
    d = rows.join(bounded_broadcast(model, k_folds * n_classes * n_measures), rows["fold"] == model["out"])
    pairs = class_pairs(rows, 2)
    # each class's partners as one array per class
    both = pairs.select(F.col("class_a").alias("cls"), F.col("class_b").alias("other")).unionByName(
        pairs.select(F.col("class_b").alias("cls"), F.col("class_a").alias("other")))
    d = d.join(bounded_broadcast(both.groupBy("cls").agg(F.collect_list("other").alias("others")), n_classes * n_classes), "cls")

    def dist(p: str):
        terms = lambda r: F.pow((r["m"] - r[p]["mu"]) / (F.sqrt((r["a"]["var"] + r["b"]["var"]) / 2) + 1e-9), F.lit(2))
        return lambda a, b: F.aggregate(F.arrays_zip(F.col("m").alias("m"), a.alias("a"), b.alias("b")), F.lit(0.0), lambda acc, r: acc + terms(r))

    def call(other):
        low, high = F.least("cls", other), F.greatest("cls", other)
        a, b = F.try_element_at("model", low), F.try_element_at("model", high)
        return F.struct(other.alias("other"), F.when(dist("a")(a, b) <= dist("b")(a, b), low).otherwise(high).alias("pred"))

    d = d.select("fold", "cls", F.explode(F.transform("others", call)).alias("_j")).select("fold", "cls", "_j.other", "_j.pred")
    n = (d.select(F.least("cls", "other").alias("class_a"), F.greatest("cls", "other").alias("class_b"), "fold", F.col("cls").alias("truth"), "pred")
         .groupBy("class_a", "class_b", "fold").agg(*[
             F.sum(((F.col("truth") == F.col(f"class_{t}")) & (F.col("pred") == F.col(f"class_{p}"))).cast("double")).alias(t + p)
             for t in "ab" for p in "ab"]))

    def balanced(c):
        ra, rb = F.try_divide(c("aa"), c("aa") + c("ab")), F.try_divide(c("bb"), c("bb") + c("ba"))
        return F.coalesce((ra + rb) / 2, ra, rb)

    f1 = lambda t, o: F.try_divide(2 * F.col(t + t), 2 * F.col(t + t) + F.col(t + o) + F.col(o + t))
    n = n.withColumns({"acc": balanced(F.col), "f1": F.coalesce((f1("a", "b") + f1("b", "a")) / 2, f1("a", "b"), f1("b", "a"))})
    s = n.groupBy("class_a", "class_b").agg(
        F.avg("acc").alias("balanced_acc"), F.stddev_pop("acc").alias("balanced_acc_sd"), F.avg("f1").alias("macro_f1"),
        *[F.sum(c).alias(c) for c in ("aa", "ab", "ba", "bb")])
    s = s.withColumn("balanced_acc_pooled", balanced(F.col))
    return s.select("class_a", "class_b", "balanced_acc", "balanced_acc_sd", "macro_f1", "balanced_acc_pooled",
                    (F.col("aa") + F.col("ab")).cast("bigint").alias("n_a"), (F.col("bb") + F.col("ba")).cast("bigint").alias("n_b"),
                    F.arrays_overlap(V.families("class_a"), V.families("class_b")).alias("same_family"))


def saved_pair_screen(spark: SparkSession, sf_dir: str, k_folds: int = 5) -> DataFrame:
    return materialize(lambda: pair_screen(spark, sf_dir, k_folds), spark, ("pairs", sf_dir, k_folds))
