"""Places of followed logs, from batch to batch: the next line of each log and generation, the lines it ends in, the next
finding number and the last arrival of each module.

They are tables, one version for each batch, read by the next one. Line numbers and finding numbers of a batch are running
sums over sorted ranges, so a module or a log may hold any share of a batch; texts are not sorted, only counts and the
last few lines of a segment are. The texts meet their numbers by the number of their row in the written batch.

Generations of a log are all remembered, in whatever order their segments come. With `forget` (an interval) those are
dropped whose last segment arrived that long before the newest of all: a segment that comes later starts at line 1 and
quotes the generation before it that is still known. A version holds every log that is not forgotten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logquarry.functions.text import split_lines
from logquarry.operators.ordered import before, sorted_ranges
from logquarry.operators.rules import hit_count, is_hit, pick
from logquarry.spec import RuleSet
from logquarry.staging import path_exists, stage

LOG = ["module", "file_path", "generation"]
LOGS = "module string, file_path string, generation long, next_line long, carried array<string>, last_arrived timestamp"
MODULES = "module string, next_index long, last_arrived timestamp, alarmed boolean"


def last_of(lines: Column, n: int) -> Column:
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), n) if n else F.slice(lines, 1, 0)


class Places:
    """The places before a batch, and those after it."""

    def __init__(self, spark: SparkSession, folder: str, prefix: int = 0, forget: str | None = None):
        self.spark, self.folder, self.prefix, self.forget = spark, folder, prefix, forget
        self.logs: DataFrame | None = None
        self.modules: DataFrame | None = None
        self.untouched: DataFrame | None = None
        # Silences that ended or were noticed in the batch, if `number` is asked for them.
        self.alarms: DataFrame | None = None

    def version(self, batch_id: int, table: str, schema: str) -> DataFrame:
        """A table as the batch before left it; empty before the first."""
        path = f"{self.folder}/version={batch_id - 1}/{table}"
        return self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def keep(self, batch_id: int) -> None:
        self.logs.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}/logs")
        self.modules.write.mode("overwrite").parquet(f"{self.folder}/version={batch_id}/modules")

    def number(self, batch: DataFrame, batch_id: int, rule_sets: list[RuleSet], started: Column | None = None,
               seeds: DataFrame | None = None, quiet_minutes: int | None = None, hits_only: bool = False) -> DataFrame:
        """The segments of a batch with mtime, start_line, first_index, carried lines and fresh.

        started        report only segments that arrived from then on; earlier ones are counted
        seeds          (module, next_index) of modules that have stored findings, for modules without a place
        quiet_minutes  find modules without a segment for longer than that
        hits_only      give back only fresh segments with a hit; the texts of others are not moved

        Segments of a log go by generation and number, whichever file they came in; equal numbers by arrival. A segment
        that comes after later ones of its generation is numbered behind them. Finding numbers of a module go on by log,
        generation and segment.
        """
        prefix = self.prefix
        fresh = F.lit(True) if started is None else F.col("arrived") >= started
        hits = F.aggregate(F.transform("body", lambda line: pick(
            rule_sets, lambda r: F.when(is_hit(line, r), hit_count(line, r)).otherwise(0))), F.lit(0), lambda a, n: a + n)
        # One line of a segment is as good as any number of them here: what can be quoted is its last `prefix` lines.
        body = batch.withColumn("body", split_lines(F.col("text")))
        rows = stage(body.select(
            *LOG, "pipeline", "segment", "arrived", "text", F.monotonically_increasing_id().alias("__row"), fresh.alias("fresh"),
            F.size("body").cast("long").alias("n_lines"), F.when(fresh, hits).otherwise(0).cast("long").alias("n_hits"),
            F.when(fresh, last_of(F.col("body"), prefix)).otherwise(F.array().cast("array<string>")).alias("final"),
        ), f"segments-{batch_id}")
        # What is sorted and summed has no text, and the pipeline stays with the text.
        facts = rows.drop("text", "pipeline").withColumn("quoted", (F.size("final") > 0).cast("long"))
        order = [F.col(c).asc_nulls_first() for c in ("module", "file_path", "generation", "segment", "arrived", "__row")]
        facts = stage(sorted_ranges(facts, order), f"facts-{batch_id}")
        placed = before(facts, LOG, order[3:], {"lines_before": "n_lines", "nth": "quoted"})
        placed = before(placed.withColumnRenamed("__range", "at"), ["module"], order[1:], {"hits_before": "n_hits"}, "at")
        placed = stage(placed, f"placed-{batch_id}")

        known = self.version(batch_id, "logs", LOGS)
        generations = self.generations(placed, known)
        self.logs = self.remembered(generations)
        known_modules = self.version(batch_id, "modules", MODULES)
        first = known_modules.select("module", F.col("next_index").alias("base"))
        if seeds is not None:
            own = first.withColumnRenamed("base", "kept").join(
                seeds.select("module", F.col("next_index").cast("long").alias("seed")), "module", "full").select(
                "module", F.coalesce("kept", "seed").alias("base"))
            first = own
        self.modules = self.modules_after(placed, known_modules, first, quiet_minutes)

        starts = generations.select(*[F.col(c).alias(f"g_{c}") for c in LOG], F.col("first_line"), F.col("start").alias("at_start"))
        same = F.lit(True)
        for c in LOG:
            same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
        out = placed.join(starts, same).join(first, "module", "left").withColumn("carried", F.col("at_start"))
        if hits_only:
            out, rows = out.where("fresh AND n_hits > 0"), rows.where("fresh AND n_hits > 0")
        if prefix:
            out = self.with_carried(out, placed)
        numbers = out.select(
            F.col("__row").alias("row"), (F.col("first_line") + F.col("lines_before")).alias("start_line"),
            (F.coalesce("base", F.lit(0)) + F.col("hits_before")).alias("first_index"), "carried")
        return rows.join(numbers, rows["__row"] == numbers["row"]).select(
            "module", "file_path", "pipeline", "generation", "segment", F.col("arrived").alias("mtime"), "start_line", "first_index",
            "carried", "text", "fresh")

    def with_carried(self, out: DataFrame, placed: DataFrame) -> DataFrame:
        """The last lines before each segment: those of the quoted segments before it in its generation, at most `prefix`
        of them as each has a line, behind what its generation starts with. They meet by their numbers, not in a window."""
        quoted = placed.where("quoted = 1").select(*[F.col(c).alias(f"q_{c}") for c in LOG], F.col("nth").alias("q_nth"), "final")
        wanted = out.where("nth > 0").select(
            *LOG, "__row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("nth") - self.prefix), F.col("nth") - 1)).alias("want"))
        same = F.col("want") == F.col("q_nth")
        for c in LOG:
            same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
        lines = wanted.join(quoted, same).groupBy(F.col("__row").alias("for_row")).agg(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("want", "final"))), lambda s: s["final"])).alias("earlier"))
        none = F.array().cast("array<string>")
        return out.join(lines, F.col("__row") == F.col("for_row"), "left").withColumn(
            "carried", last_of(F.concat("carried", F.coalesce("earlier", none)), self.prefix))

    def generations(self, placed: DataFrame, known: DataFrame) -> DataFrame:
        """Of each log with a segment in the batch, all generations: first_line and start (the lines it begins behind) in
        this batch, end and next_line after it. A generation not known starts behind the end of the one before it; the
        list of the generations of one log is one row."""
        prefix = self.prefix
        sums = placed.groupBy(*LOG).agg(
            F.sum("n_lines").alias("lines"), F.sum("quoted").alias("n"), F.max("arrived").alias("arrived"))
        tail = placed.join(sums.select(*[F.col(c).alias(f"s_{c}") for c in LOG], "n"), [
            F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in LOG]).where(
            (F.col("quoted") == 1) & (F.col("nth") >= F.col("n") - prefix)).groupBy(*LOG).agg(last_of(F.flatten(F.transform(
                F.sort_array(F.collect_list(F.struct("nth", "final"))), lambda s: s["final"])), prefix).alias("tail"))
        none = F.array().cast("array<string>")
        batch = sums.join(tail.select(*[F.col(c).alias(f"t_{c}") for c in LOG], "tail"), [
            F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in LOG], "left").select(
            *LOG, "lines", "arrived", F.coalesce("tail", none).alias("tail"), F.lit(None).cast("long").alias("next_line"), none.alias("carried"))
        logs = batch.select(F.col("module").alias("l_module"), F.col("file_path").alias("l_path")).distinct()
        old = known.join(
            logs, F.col("module").eqNullSafe(F.col("l_module")) & F.col("file_path").eqNullSafe(F.col("l_path")), "left").withColumn(
            "touched", F.col("l_path").isNotNull())
        self.untouched = old.where("NOT touched").select(*known.columns)
        before_ = old.where("touched").select(
            *LOG, F.lit(0).cast("long").alias("lines"), F.col("last_arrived").alias("arrived"), none.alias("tail"), "next_line", "carried")
        each = batch.union(before_).groupBy(*LOG).agg(
            F.sum("lines").alias("lines"), F.max("arrived").alias("arrived"), F.max("tail").alias("tail"),
            F.max("next_line").alias("next_line"), F.max("carried").alias("carried"))
        listed = each.groupBy("module", "file_path").agg(F.sort_array(F.collect_list(F.struct(
            "generation", "lines", "arrived", "tail", "next_line", "carried"))).alias("all"))
        made = "array<struct<generation:bigint,first_line:bigint,start:array<string>,next_line:bigint,carried:array<string>,last_arrived:timestamp>>"

        def step(done, g):
            start = F.when(g["next_line"].isNotNull(), g["carried"]).otherwise(F.coalesce(F.try_element_at(done, F.lit(-1))["carried"], none))
            first = F.coalesce(g["next_line"], F.lit(1).cast("long"))
            return F.concat(done, F.array(F.struct(
                g["generation"].alias("generation"), first.alias("first_line"), start.alias("start"), (first + g["lines"]).alias("next_line"),
                last_of(F.concat(start, g["tail"]), prefix).alias("carried"), g["arrived"].alias("last_arrived"))))

        chained = listed.select("module", "file_path", F.aggregate("all", F.array().cast(made), step).alias("all"))
        return stage(chained.select("module", "file_path", F.explode("all").alias("g")).select("module", "file_path", "g.*"), "generations")

    def remembered(self, generations: DataFrame) -> DataFrame:
        every = self.untouched.union(generations.select(*LOG, "next_line", "carried", "last_arrived"))
        if self.forget is None:
            return every
        newest = every.agg(F.max("last_arrived")).first()[0]
        return every.where(F.col("last_arrived") >= F.lit(newest) - F.expr(f"INTERVAL {self.forget}"))

    def modules_after(self, placed: DataFrame, known: DataFrame, first: DataFrame, quiet_minutes: int | None) -> DataFrame:
        now = placed.groupBy("module").agg(F.sum("n_hits").alias("hits"), F.max("arrived").alias("arrived"))
        both = stage(known.join(now, "module", "full").join(first, "module", "left").select(
            "module", (F.coalesce("base", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("next_index"),
            F.col("last_arrived").alias("before"), F.greatest("last_arrived", "arrived").alias("last_arrived"),
            F.coalesce("alarmed", F.lit(False)).alias("alarmed")), "modules")
        if quiet_minutes is None:
            return both.drop("before")
        # Arrivals that are older than a module's last one end no silence. One that was told is not told again.
        later = placed.select("module", "arrived").join(both.select("module", "before", "alarmed"), "module").where(
            "before IS NULL OR arrived > before").select("module", "arrived")
        told = both.where("alarmed").select("module", F.col("before").alias("silent_since"))
        all_since = stage(silences(later.union(both.where("before IS NOT NULL").select("module", "before")), quiet_minutes), "silences")
        self.alarms = all_since.join(told, ["module", "silent_since"], "left_anti").select(*all_since.columns)
        lasting = all_since.select("module", F.col("silent_since").alias("last_arrived"), F.lit(True).alias("lasting"))
        return both.join(lasting, ["module", "last_arrived"], "left").select(
            "module", "next_index", "last_arrived", F.coalesce("lasting", F.lit(False)).alias("alarmed"))


def silences(arrivals: DataFrame, minutes: int) -> DataFrame:
    """Stretches of more than `minutes` without an arrival: module, silent_since, alarm_at.

    `arrivals` (module, arrived) may hold any number of rows of a module: they are first reduced to the first and last of
    each stretch of that length, as a silence only lies between such. The newest arrival of all is the present, so a
    module that has been silent until now has its row, once.
    """
    width = minutes * 60
    newest = F.lit(arrivals.agg(F.max("arrived")).first()[0]).cast("timestamp")
    ends = arrivals.where("arrived IS NOT NULL").groupBy("module", F.floor(F.unix_timestamp("arrived") / width).alias("stretch")).agg(
        F.min("arrived").alias("first"), F.max("arrived").alias("last"))
    after = F.lead("first").over(Window.partitionBy("module").orderBy("stretch"))
    gaps = ends.select("module", F.col("last").alias("silent_since"), F.coalesce(after, newest).alias("until"))
    alarm = F.timestamp_seconds(F.unix_micros("silent_since") / 1_000_000 + width)
    return gaps.withColumn("alarm_at", alarm).where(F.unix_micros("until") - F.unix_micros("silent_since") > width * 1_000_000).select(
        "module", "silent_since", "alarm_at")
