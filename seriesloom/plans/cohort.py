"""Subject-held-out designs: who is recorded, who stays new, which series train and which test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.hashing import draw_bucket, draw_key
from seriesloom.functions.ordering import first_k, split_rank
from seriesloom.session import bounded_broadcast


@dataclass(frozen=True)
class Design:
    """Parameters of a repeated, nested, subject-held-out experiment."""

    seed: int = 7
    repeats: int = 3
    n_new: int = 2
    sizes: tuple[int, ...] = (2, 4, 6)
    ks: tuple[int, ...] = (1, 2)
    n_classes: int = 10
    condition: tuple[str, ...] = field(default=("repeat", "n_team", "k"))

    @property
    def max_roles(self) -> int:
        return self.repeats * (self.n_new + max(self.sizes))

    @property
    def max_train(self) -> int:
        return self.repeats * sum(n * k for n in self.sizes for k in self.ks) * self.n_classes

    @property
    def max_conditions(self) -> int:
        return self.repeats * len(self.sizes) * len(self.ks)


def make_roles(subjects: DataFrame, design: Design) -> DataFrame:
    """Per repeat the whole pool in seeded order: the first ``n_new`` subjects are new, all others candidates."""
    d = rank_subjects(subjects, design.repeats, design.seed)
    return d.select("repeat", "subject",
                    F.when(F.col("rank") <= design.n_new, "new").otherwise("candidate").alias("role"),
                    F.when(F.col("rank") <= design.n_new, F.col("rank")).otherwise(F.col("rank") - design.n_new).alias("rank"))


def team_roles(roles: DataFrame, design: Design) -> DataFrame:
    """The new subjects and the candidates of the largest team: at most ``max_roles`` rows."""
    return roles.where((F.col("role") == "new") | (F.col("rank") <= max(design.sizes)))


def rank_subjects(subjects: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Seeded rank of every subject per repeat."""
    d = (subjects.select("subject").distinct()
         .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
         .withColumn("_o", draw_key(seed, "repeat", "subject")))
    return split_rank(d, ["repeat"], [F.col("_o"), F.col("subject")], draw_bucket(F.col("_o"))).drop("_o")


def nested_set_order(bouts: DataFrame, roles: DataFrame, design: Design, max_k: int | None = None) -> DataFrame:
    """Seeded order of the first-period series within each (repeat, candidate, class), first ``max_k`` kept."""
    cand = roles.where("role = 'candidate'").select("repeat", "subject", F.col("rank").alias("team_rank"))
    d = (bouts.where("period_order = 1").select("series_id", "subject", "cls")
         .join(cand, "subject")
         .withColumn("_o", draw_key(design.seed, "repeat", "series_id")))
    return first_k(d, ["repeat", "subject", "cls"], [F.col("_o"), F.col("series_id")],
                   max_k or max(design.ks), "set_rank").drop("_o")


def cells(design: Design, wanted: Column | None = None) -> Column:
    """The (n_team, k) grid as an array literal, optionally filtered per row."""
    grid = F.array(*[F.struct(F.lit(n).alias("n_team"), F.lit(k).alias("k")) for n in design.sizes for k in design.ks])
    return grid


def train_sets(order: DataFrame, design: Design) -> DataFrame:
    """Series of the first N candidates and first k sets, for every cell of the grid."""
    fits = F.filter(cells(design), lambda c: (c["n_team"] >= F.col("team_rank")) & (c["k"] >= F.col("set_rank")))
    return (order.select("repeat", "subject", "cls", "series_id", F.explode(fits).alias("_c"))
            .select("repeat", "_c.n_team", "_c.k", "subject", "cls", "series_id"))


def test_sets(bouts: DataFrame, roles: DataFrame, design: Design) -> DataFrame:
    """Later-period series of the recorded team and of the new subjects, for every cell."""
    r = roles.withColumn("_cells", F.filter(
        cells(design), lambda c: (F.col("role") == "new") | (c["n_team"] >= F.col("rank"))))
    r = r.select("repeat", "subject", F.when(F.col("role") == "new", "new").otherwise("recorded").alias("role"), "_cells")
    return (bouts.where("period_order > 1").select("series_id", "subject", "cls")
            .join(bounded_broadcast(r, design.max_roles), "subject")
            .select("repeat", F.explode("_cells").alias("_c"), "role", "subject", "cls", "series_id")
            .select("repeat", "_c.n_team", "_c.k", "role", "subject", "cls", "series_id"))


def missing_sets(train: DataFrame, design: Design) -> DataFrame:
    """Guard for top-k selection: (repeat, n_team, k, subject, class) cells with fewer than k series."""
    have = train.groupBy("repeat", "n_team", "k", "subject", "cls").agg(F.count(F.lit(1)).alias("n_sets"))
    per_subject = have.groupBy("repeat", "n_team", "k", "subject").agg(
        F.sum((F.col("n_sets") >= F.col("k")).cast("int")).alias("full_classes"))
    return per_subject.select("repeat", "n_team", "k", "subject",
                              (F.lit(design.n_classes) - F.col("full_classes")).cast("bigint").alias("short_classes"))


def leak_violations(train: DataFrame, test: DataFrame, bouts: DataFrame, roles: DataFrame) -> DataFrame:
    """Three emptiness checks as (check, n_violations) rows."""
    cond = ["repeat", "n_team", "k"]
    both = train.join(test, [*cond, "series_id"], "left_semi").select(F.lit("series in train and test").alias("check"))
    period = bouts.select("series_id", "period_order")
    wrong_day = (train.join(period, "series_id").where("period_order <> 1")
                 .select(F.lit("period rule").alias("check"))
                 .unionByName(test.join(period, "series_id").where("period_order <= 1").select(F.lit("period rule").alias("check"))))
    new = roles.where("role = 'new'").select("repeat", "subject")
    new_in = train.join(new, ["repeat", "subject"], "left_semi").select(F.lit("new subject in train").alias("check"))
    names = F.array(*[F.lit(n) for n in ("series in train and test", "period rule", "new subject in train")])
    spark = train.sparkSession
    all_checks = spark.range(1).select(F.explode(names).alias("check"))
    found = both.unionByName(wrong_day).unionByName(new_in).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return all_checks.join(found, "check", "left").select("check", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_violations"))


def shared_values(a: DataFrame, b: DataFrame, key: str = "subject") -> DataFrame:
    """Values of ``key`` that both tables hold, NULL left out."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_semi")


def refuse_shared(a: DataFrame, b: DataFrame, key: str = "subject", shown: int = 20) -> None:
    """Raise where two tables share a subject, with the names of the first ones."""
    names = [r[0] for r in shared_values(a, b, key).orderBy(key).limit(shown + 1).collect()]
    if names:
        more = " and more" if len(names) > shown else ""
        raise ValueError(f"both tables hold {key} {', '.join(map(str, names[:shown]))}{more}")


def refuse_missing(train: DataFrame, design: Design, shown: int = 20) -> None:
    """Raise where a subject of a cell has fewer than k series of a class, with the cells and subjects that lack them."""
    short = missing_sets(train, design).where("short_classes > 0").orderBy("repeat", "n_team", "k", "subject").limit(shown).collect()
    if short:
        raise ValueError("too few series: " + "; ".join(
            f"repeat {r['repeat']}, {r.n_team} subjects, {r.k} sets: subject {r.subject} lacks them in {r.short_classes} classes" for r in short))


def extra_sets(order: DataFrame, n_team: int, extra_classes: Sequence[int]) -> DataFrame:
    """One series per class, two for the chosen classes, of the first ``n_team`` candidates."""
    allowed = F.when(F.col("cls").isin(*extra_classes), 2).otherwise(1)
    return order.where((F.col("team_rank") <= n_team) & (F.col("set_rank") <= allowed))


def depth_sets(bouts: DataFrame, roles: DataFrame, design: Design, n_team: int, depth: int,
               chronological: Sequence[str]) -> DataFrame:
    """First ``depth`` series per class across periods: seeded order in the first one, then by time."""
    cand = roles.where(f"role = 'candidate' and rank <= {int(n_team)}").select("repeat", "subject")
    d = (bouts.join(bounded_broadcast(cand, design.max_roles), "subject")
         .withColumn("_late", F.col("period_order") > 1)
         .withColumn("_o", F.when(~F.col("_late"), draw_key(design.seed, "repeat", "series_id"))))
    order = [F.col("_late"), F.col("_o"), *[F.when(F.col("_late"), F.col(c)) for c in chronological], F.col("series_id")]
    return first_k(d, ["repeat", "subject", "cls"], order, depth, "set_rank").select(
        "repeat", "subject", "cls", "series_id", "period_order", "set_rank")


def subject_split(subjects: DataFrame, frac: float, seed: int) -> DataFrame:
    """max(1, round(frac * n)) seeded test subjects; every subject is labelled train or test."""
    ranked = rank_subjects(subjects, 1, seed)
    n = subjects.select("subject").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_test = F.greatest(F.lit(1), F.rint(n * F.lit(float(frac)))).cast("int")
    return ranked.select("subject", F.when(F.col("rank") <= n_test, "test").otherwise("train").alias("part"))


def group_kfold(rows: DataFrame, k: int) -> DataFrame:
    """Fold of each subject: subjects by size, dealt out in snake order, no subject in two folds."""
    sizes = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows"))
    # subjects of one size are numbered in the order of their digests, whatever the type of their ids
    sizes = sizes.withColumns({"_all": F.lit(0), "_o": draw_key(0, "subject")})
    piece = F.struct((-F.col("n_rows")).alias("size"), draw_bucket(F.col("_o"), 2).alias("part"))
    ranked = split_rank(sizes, ["_all"], [F.col("n_rows").desc(), F.col("_o"), F.col("subject")], piece)
    r = F.col("rank") - 1
    snake = F.when(F.floor(r / k) % 2 == 0, r % k).otherwise(k - 1 - r % k)
    return ranked.select("subject", "n_rows", snake.cast("int").alias("fold"))
