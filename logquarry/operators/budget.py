"""Token usage over rolling windows, and admission against a budget."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logquarry.operators.ordered import along, islands
from logquarry.staging import stage

HOUR = 3_600_000_000
DAY = 86_400_000_000
FINE = 60_000_000
# Instants in microseconds are cut into blocks of 2^26, a little over a minute.
TIME_BITS = 26

DECISION = "provider string, request_id long, at_us long, estimated long, used long, admitted boolean"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rolling_usage(log: DataFrame, windows: dict[str, int], key: str = "provider", at: str = "at_us",
                  tokens: str = "tokens") -> DataFrame:
    """Per instant and provider, the tokens of the trailing windows (name -> microseconds), ends included.

    One row per (provider, instant). A provider may hold most of the log, so no window group spans more than a minute
    of it: the sum up to an instant is the sum of whole earlier minutes (one row per minute) plus a running sum inside
    the minute. A trailing window is the difference of two such sums, the second one just before its start.
    """
    usage = log.groupBy(key, at).agg(F.sum(tokens).cast("long").alias("used"))
    probes = usage.select(key, at, "used", F.explode(F.array(
        F.struct(F.lit("").alias("name"), F.col(at).alias("point")),
        *[F.struct(F.lit(n).alias("name"), (F.col(at) - w - 1).alias("point")) for n, w in windows.items()],
    )).alias("p"))
    # A point counts what lies at or before it; rows that are only asked about add nothing.
    points = probes.select(
        key, F.col(at).alias("row_at"), "p.name", F.col("p.point").alias("point"),
        F.when(F.col("p.name") == "", F.col("used")).otherwise(0).alias("adds"))
    minute = F.expr(f"floor(point / {FINE})")
    inside = Window.partitionBy(key, "minute").orderBy("point").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = points.withColumn("minute", minute)
    totals = placed.groupBy(key, "minute").agg(F.sum("adds").alias("of_minute"))
    # At most one row per minute of a provider, so this window is bounded by the length of the log in time.
    earlier = Window.partitionBy(key).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "minute", F.coalesce(F.sum("of_minute").over(earlier), F.lit(0)).alias("before"))
    known = placed.withColumn("local", F.sum("adds").over(inside)).join(carried, [key, "minute"])
    level = F.col("local") + F.col("before")
    per_row = known.groupBy(key, F.col("row_at").alias(at)).agg(
        F.max(F.when(F.col("name") == "", level)).alias("upto"),
        F.max(F.when(F.col("name") == "", F.col("adds"))).alias("used"),
        *[F.max(F.when(F.col("name") == n, level)).alias(f"before_{n}") for n in windows])
    return per_row.select(
        key, at, "used", *[(F.col("upto") - F.col(f"before_{n}")).cast("long").alias(n) for n in windows])


def admit(requests: DataFrame, hourly: dict[str, int], daily: dict[str, int]) -> DataFrame:
    """Decide each request (provider, request_id, at_us, estimated, used): refuse it when the tokens recorded in the
    last hour or day plus its estimate pass the cap. A refused request records nothing.

    Decisions depend on earlier ones, but only near the cap. A request is safe when all requests of its windows together
    fit, refused ones included. A risky one depends on at most a day before it. So each provider's time line is cut
    where no risky request lies within a day, safe requests outside those stretches are admitted at once, and only the
    stretches are decided in order, streaming, with a day of state.
    """
    is_capped = F.col("provider").isin(sorted({*hourly, *daily}))
    decision = ["provider", "request_id", "at_us", "estimated", "used"]
    uncapped = requests.where(~is_capped).select(*decision, F.lit(True).alias("admitted"))
    requests = requests.where(is_capped)
    log = requests.select("provider", "at_us", F.greatest("used", "estimated").alias("tokens"))
    usage = rolling_usage(log, {"in_hour": HOUR, "in_day": DAY}).drop("used")

    def cap(limits: dict[str, int]) -> Column:
        out = F.lit(None).cast("long")
        for name, limit in limits.items():
            out = F.when(F.col("provider") == name, limit).otherwise(out)
        return out

    # The windows hold the request itself and its ties, which can only overstate what was recorded before it.
    risky = F.coalesce(F.col("in_hour") > cap(hourly), F.lit(False)) | F.coalesce(
        F.col("in_day") > cap(daily), F.lit(False))
    instants = stage(usage.select("provider", "at_us", risky.alias("risky")), "instants")
    near = along(instants, ["provider"], "at_us", bits=TIME_BITS,
                 following={"next_risk": F.when(F.col("risky"), F.col("at_us"))})
    contested = F.col("risky") | F.coalesce(F.col("next_risk") - F.col("at_us") <= DAY, F.lit(False))
    stretches = islands(near.select("provider", "at_us", contested.alias("contested")), ["provider"], "at_us",
                        "contested", "stretch", bits=TIME_BITS)
    rows = requests.join(stretches, ["provider", "at_us"])
    decided = (
        rows.where("contested")
        .repartition("provider", "stretch")
        .sortWithinPartitions("provider", "stretch", "at_us", "request_id")
        .select("provider", "stretch", "request_id", "at_us", "estimated", "used")
        .mapInPandas(in_order(hourly, daily), DECISION)
    )
    free = rows.where(~F.col("contested")).select(*decision, F.lit(True).alias("admitted"))
    return free.unionByName(decided).unionByName(uncapped)


def admit_stream(requests: DataFrame, hourly: dict[str, int], daily: dict[str, int]) -> DataFrame:
    """The same decision on a stream, in arrival order; the state of a provider is what it recorded in the last day."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        provider = key[0]
        recorded = list(zip(*state.get)) if state.exists else []
        batch = pd.concat(list(batches), ignore_index=True).sort_values(["at_us", "request_id"], kind="stable")
        ledger, verdicts = Ledger(recorded), []
        for at, estimated, used in zip(batch.at_us, batch.estimated, batch.used):
            verdicts.append(ledger.offer(at, estimated, used, hourly.get(provider), daily.get(provider)))
        state.update(([int(at) for at, _ in ledger.day], [int(spent) for _, spent in ledger.day]))
        yield batch.assign(admitted=verdicts)[["provider", "request_id", "at_us", "estimated", "used", "admitted"]]

    return requests.groupBy("provider").applyInPandasWithState(
        run, DECISION, "at array<long>, spent array<long>", "append", GroupStateTimeout.NoTimeout)


class Ledger:
    """Tokens recorded in the last hour and day."""

    def __init__(self, recorded=()):
        self.day, self.hour = deque(recorded), deque(recorded)
        self.day_sum = self.hour_sum = sum(spent for _, spent in recorded)

    def offer(self, at: int, estimated: int, used: int, hourly: int | None, daily: int | None) -> bool:
        while self.day and self.day[0][0] < at - DAY:
            self.day_sum -= self.day.popleft()[1]
        while self.hour and self.hour[0][0] < at - HOUR:
            self.hour_sum -= self.hour.popleft()[1]
        if hourly is not None and self.hour_sum + estimated > hourly or (
                daily is not None and self.day_sum + estimated > daily):
            return False
        spent = used if used > 0 else estimated
        self.day.append((at, spent))
        self.hour.append((at, spent))
        self.day_sum, self.hour_sum = self.day_sum + spent, self.hour_sum + spent
        return True


def in_order(hourly: dict[str, int], daily: dict[str, int]):
    """Decide sorted requests one after another, starting afresh with each stretch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ledger = None, Ledger()
        for batch in batches:
            verdicts = []
            for provider, stretch, at, estimated, used in zip(
                    batch.provider, batch.stretch, batch.at_us, batch.estimated, batch.used):
                if (provider, stretch) != current:
                    current, ledger = (provider, stretch), Ledger()
                verdicts.append(ledger.offer(at, estimated, used, hourly.get(provider), daily.get(provider)))
            yield batch.assign(admitted=verdicts)[
                ["provider", "request_id", "at_us", "estimated", "used", "admitted"]]

    return run
