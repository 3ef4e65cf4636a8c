"""Small set operations on keyed tables: toggles, latest values, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order and weights of the phases.
PHASES = (
    ("loading-models", 15), ("extracting-frames", 10), ("detecting-faces", 25), ("recognizing-faces", 25), ("clustering", 5),
    ("waiting-selection", 0), ("processing-frames", 15), ("reconstructing", 5),
)


def toggled(events: DataFrame, by: list[str], item: str) -> DataFrame:
    """Items chosen an odd number of times: the outcome of switching each on and off in turn."""
    return events.groupBy(*by, item).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*by, item)


def latest(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def overall_percent(progress: DataFrame) -> DataFrame:
    """progress(phase, phase_percent) with overall_percent: weights before the phase and its share; 80 once selection waits."""
    before, cases = 0, F.lit(80.0)
    whens = None
    for phase, weight in PHASES[:5]:
        value = before + F.col("phase_percent") * weight / 100
        whens = F.when(F.col("phase") == phase, value) if whens is None else whens.when(F.col("phase") == phase, value)
        before += weight
    return progress.withColumn("overall_percent", F.least(F.lit(100.0), F.floor(whens.otherwise(cases) + 0.5).cast("double")))


#: Fixed order of the phases that are shown as steps.
STEPS = ("extracting-frames", "detecting-faces", "recognizing-faces", "clustering", "processing-frames", "reconstructing")


def everything(identities: DataFrame, by: list[str], item: str) -> DataFrame:
    """All items of each group chosen."""
    return identities.select(*by, item).distinct()


def nothing(identities: DataFrame, by: list[str], item: str) -> DataFrame:
    """No item chosen."""
    return identities.select(*by, item).where("false")


def all_chosen(identities: DataFrame, chosen: DataFrame, by: list[str], item: str) -> DataFrame:
    """Whether every item of each group, of which there is one at least, is chosen."""
    marked = everything(identities, by, item).join(chosen.select(*by, item).distinct().withColumn("_in", F.lit(True)), [*by, item], "left")
    return marked.groupBy(*by).agg(F.every(F.col("_in").isNotNull()).alias("all_selected"))


def overrides(events: DataFrame, by: list[str], item: str, order: str, clears: Column) -> DataFrame:
    """The last value of each item since its group's last clearing event; items not set since have none."""
    last = F.max(F.when(clears, F.col(order))).over(Window.partitionBy(*by))
    kept = events.withColumn("_clear", last).where(~clears & (F.col("_clear").isNull() | (F.col(order) > F.col("_clear")))).drop("_clear")
    return latest(kept, [*by, item], order)


def merged(updates: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Partial records folded into one for each key: of every field the last value that was given."""
    return updates.groupBy(*by).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields
    ])


def running_totals(rows: DataFrame, by: list[str], order: str, value: Column, name: str = "total") -> DataFrame:
    """rows with the sum of `value` up to each, by `order`."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def loading_percent(models: DataFrame, by: list[str], order: str, share: float = 60.0) -> DataFrame:
    """models with the progress shown before each is loaded: the share of those before it."""
    group = Window.partitionBy(*by)
    before = F.row_number().over(group.orderBy(order)) - 1
    return models.withColumn("loading_percent", before / F.count("*").over(group) * share)


def frame_percent(progress: DataFrame) -> DataFrame:
    """progress(done, total) with the whole per cent of frames, 99 at most; null without a total."""
    percent = F.floor(F.try_divide(F.col("done") * 100.0, F.col("total")) + 0.5).cast("double")
    return progress.withColumn("percent", F.when(percent > 99, 99.0).otherwise(percent))


def step_index(phase: Column) -> Column:
    """The step shown for a phase: loading is the first, waiting and done are past the last, any other that is no step is the first."""
    out = F.when(phase.isin("waiting-selection", "done"), F.lit(len(STEPS)))
    for n, step in enumerate(STEPS):
        out = out.when(phase == step, F.lit(n))
    return out.otherwise(F.lit(0))
