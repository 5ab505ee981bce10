"""Tokens and list-price dollars.

usage: one row per record with (session_id, record, message_id, model, speed, service_tier, inference_geo, input, output,
cache_creation, cache_5m, cache_1h, cache_read); counts are null where the harness states none.
sessions: (session_id, source_agent, archived_at, repository).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom import constants as C
from tallyloom.functions.predicates import billing_signal
from tallyloom.shared import cut

#: Rows of a price table up to which it is broadcast (some 200 bytes each).
MOST_PRICES = 10_000


def _small(table: DataFrame) -> DataFrame:
    """A table with the hint to broadcast it, if it is as small as price tables are."""
    return F.broadcast(table) if table.count() <= MOST_PRICES else table


KEY = ["model", "speed", "service_tier", "inference_geo"]
COUNTS = ["input", "output", "cache_write_5m", "cache_write_1h", "cache_write_untiered", "cache_read"]


def billed(usage: DataFrame) -> DataFrame:
    """The first record of each message, and all records without a message id."""
    w = Window.partitionBy("session_id", "message_id").orderBy("record")
    return usage.withColumn("nth", F.when(F.col("message_id").isNull(), 1).otherwise(F.row_number().over(w))).filter("nth = 1").drop("nth")


def tallies(usage: DataFrame) -> DataFrame:
    """(session_id, *KEY, messages, *COUNTS, untiered_messages): cache writes by tier where a record states tiers."""
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    tiered = (z("cache_5m") > 0) | (z("cache_1h") > 0)
    rows = billed(usage).select(
        "session_id", *KEY, z("input").alias("input"), z("output").alias("output"),
        F.when(tiered, z("cache_5m")).otherwise(0).alias("cache_write_5m"), F.when(tiered, z("cache_1h")).otherwise(0).alias("cache_write_1h"),
        F.when(tiered, 0).otherwise(z("cache_creation")).alias("cache_write_untiered"), z("cache_read").alias("cache_read"),
    )
    return rows.groupBy("session_id", *KEY).agg(
        F.count(F.lit(1)).alias("messages"), *(F.sum(c).cast("long").alias(c) for c in COUNTS), F.sum((F.col("cache_write_untiered") > 0).cast("long")).alias("untiered_messages")
    )


def price_table(spark: SparkSession, rows: tuple = C.PRICES) -> DataFrame:
    """(model, effective_from, effective_to, rates, fast, us_geo_multiplier, top_output): as many rows as PRICES."""
    rates = "struct<input:double,output:double,cache_write_5m:double,cache_write_1h:double,cache_read:double>"
    flat = lambda r: None if r is None else (r.input, r.output, r.cache_write_5m, r.cache_write_1h, r.cache_read)
    data = [(p.model, p.effective_from, flat(p.rates), flat(p.fast), p.us_geo_multiplier) for p in rows]
    df = spark.createDataFrame(data, f"model string, effective_from string, rates {rates}, fast {rates}, us_geo_multiplier double")
    w = Window.partitionBy("model").orderBy("effective_from")
    return df.withColumn("effective_from", F.col("effective_from").cast("timestamp")).withColumn("effective_to", F.lead("effective_from").over(w))


def top_rates(prices: DataFrame) -> DataFrame:
    """(opens, closes, top_output): between two dates of the price table the highest output rate of any model."""
    dates = prices.select(F.col("effective_from").alias("opens")).distinct()
    live = dates.join(_small(prices), (F.col("effective_from") <= F.col("opens")) & (F.col("effective_to").isNull() | (F.col("opens") < F.col("effective_to"))))
    tops = live.groupBy("opens").agg(F.max("rates.output").alias("top_output"))
    return tops.withColumn("closes", F.lead("opens").over(Window.orderBy("opens")))


def dollars(tokens: Column, rate: Column, multiplier: Column) -> Column:
    return tokens / F.lit(1e6) * rate * multiplier


def priced(tally: DataFrame, sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """tally with state (priced, unbilled or the reason it isn't priced), dollars and cache economics.

    The price row is that of the session's archive time. The order of refusals is part of the result: no model,
    synthetic, no archive time, no row (unknown model or no rate yet), tier, speed, region. Prices are broadcast up to
    MOST_PRICES rows.
    """
    p = _small(prices)
    t = tally.join(sessions.select("session_id", "source_agent", "archived_at", "repository"), "session_id")
    at = F.col("archived_at")
    joined = t.alias("t").join(
        p.alias("p"),
        (F.col("t.model") == F.col("p.model")) & (F.col("p.effective_from") <= at) & (F.col("p.effective_to").isNull() | (at < F.col("p.effective_to"))),
        "left",
    )
    known = F.array(*map(F.lit, sorted({r.model for r in C.PRICES})))
    c = F.col
    fast = c("speed") == C.FAST_SPEED
    state = (
        F.when(c("t.model").isNull(), "no-model")
        .when(c("t.model") == C.SYNTHETIC_MODEL, "unbilled")
        .when(at.isNull(), "no-archive-time")
        .when(c("p.model").isNull(), F.when(F.array_contains(known, c("t.model")), "no-rate-yet").otherwise("unknown-model"))
        .when(c("service_tier") != C.STANDARD_TIER, "service-tier")
        .when(fast & c("fast").isNull(), "speed")
        .when(~c("speed").isin(C.STANDARD_SPEED, C.FAST_SPEED), "speed")
        .when((c("inference_geo") == C.US_GEO) & c("us_geo_multiplier").isNull(), "inference-geo")
        .when(~c("inference_geo").isin(C.NO_GEO, C.US_GEO), "inference-geo")
        .otherwise("priced")
    )
    rate = F.when(fast, c("fast")).otherwise(c("rates"))
    by = F.when(c("inference_geo") == C.US_GEO, c("us_geo_multiplier")).otherwise(F.lit(1.0))
    out = joined.select("t.*", state.alias("state"), rate.alias("rate"), by.alias("by"), fast.alias("is_fast"))
    part = lambda tokens, name: dollars(c(tokens), c("rate")[name], c("by"))
    total = part("input", "input") + part("output", "output") + part("cache_write_5m", "cache_write_5m") + part("cache_write_1h", "cache_write_1h") + part("cache_read", "cache_read")
    ok = c("state") == "priced"
    return (
        out.withColumn("dollars", F.when(ok, total))
        .withColumn("cache_read_dollars", F.when(ok, part("cache_read", "cache_read")))
        .withColumn("cache_read_at_input_rate", F.when(ok, part("cache_read", "input")))
        .withColumn("fast_messages", F.when(ok & c("is_fast"), c("messages")).otherwise(0))
        .withColumn("output_rate", c("rate.output"))
        .drop("rate", "by", "is_fast")
    )


def cost_totals(lines: DataFrame) -> DataFrame:
    """(by, label, messages, output, dollars, cache_saving): all, by model and by repository in one pass."""
    p = lines.filter("state = 'priced'")
    grouped = p.groupingSets([[], ["model"], ["repository"]], "model", "repository").agg(
        F.grouping_id().alias("g"), F.sum("messages").alias("messages"), F.sum("output").alias("output"), F.sum("dollars").alias("dollars"), F.sum(F.col("cache_read_at_input_rate") - F.col("cache_read_dollars")).alias("cache_saving"), F.sum("fast_messages").alias("fast_messages")
    )
    by = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "model").otherwise("repository")
    return grouped.select(by.alias("by"), F.when(F.col("g") == 1, F.col("model")).when(F.col("g") == 2, F.col("repository")).alias("label"), "messages", "output", "dollars", "cache_saving", "fast_messages")


def unpriced(lines: DataFrame) -> DataFrame:
    """(state, model, messages, output) of what has no dollars."""
    return lines.filter("state <> 'priced'").groupBy("state", "model").agg(F.sum("messages").alias("messages"), F.sum("output").alias("output"))


def premium_sessions(lines: DataFrame, prices: DataFrame, most_output: int = C.PREMIUM_MAX_OUTPUT, most_messages: int = C.PREMIUM_MAX_MESSAGES) -> DataFrame:
    """Small sessions billed wholly at the day's top tier: (session_id, dollars, output, messages, models).

    A model is of the top tier if its own output rate is the highest of all models at the session's archive time.
    """
    tops = _small(top_rates(prices))  # one row for each date of the price table
    base = _small(prices.select(F.col("model").alias("m"), "effective_from", "effective_to", F.col("rates.output").alias("own")))
    at = F.col("archived_at")
    j = lines.join(tops, (F.col("opens") <= at) & (F.col("closes").isNull() | (at < F.col("closes"))), "left").join(
        base, (F.col("model") == F.col("m")) & (F.col("effective_from") <= at) & (F.col("effective_to").isNull() | (at < F.col("effective_to"))), "left"
    )
    ok = F.col("state") == "priced"
    total = F.col("input") + F.col("output") + F.col("cache_write_5m") + F.col("cache_write_1h") + F.col("cache_write_untiered") + F.col("cache_read")
    return (
        j.groupBy("session_id")
        .agg(
            F.bool_or(ok).alias("any_priced"),
            F.bool_and(F.when(ok, F.col("own") == F.col("top_output"))).alias("wholly"),
            F.sum(F.when(ok, 0).otherwise(total)).alias("unpriced_tokens"),
            F.sum("dollars").alias("dollars"),
            F.sum(F.when(ok, F.col("output"))).alias("output"),
            F.sum(F.when(ok, F.col("messages"))).alias("messages"),
            F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("model")))), ",").alias("models"),
        )
        .filter((F.col("any_priced")) & F.col("wholly") & (F.col("unpriced_tokens") == 0) & (F.col("output") <= most_output) & (F.col("messages") <= most_messages))
        .select("session_id", "dollars", "output", "messages", "models")
    )


def token_only(tally: DataFrame, sessions: DataFrame) -> DataFrame:
    """(model, messages, output) of harnesses that state tokens and no billing."""
    s = sessions.filter(billing_signal(F.col("source_agent")) == "tokens-only").select("session_id")
    return tally.join(s, "session_id", "left_semi").groupBy("model").agg(F.sum("messages").alias("messages"), F.sum("output").alias("output"))


def comparison_state(reported: float | None, comparison: float | None, has_window: bool) -> str:
    """no-window, nothing-priced or compared."""
    if not has_window:
        return "no-window"
    return "nothing-priced" if reported is None and comparison is None else "compared"


def in_order(totals: DataFrame, by: str) -> DataFrame:
    """The rows of cost_totals by model or repository with their place: dollars, then name, the one without a name first among equals."""
    w = Window.orderBy(F.desc("dollars"), F.asc_nulls_first("label"))  # one row per model or repository
    return totals.filter(F.col("by") == by).withColumn("place", F.row_number().over(w).cast("long"))


def listed(premium: DataFrame, most: int = C.PREMIUM_LISTED) -> DataFrame:
    """The first `most` premium sessions by dollars, then id, with place and the number that was found."""
    found = cut(premium, "premium")
    total = found.agg(F.count(F.lit(1)).alias("found"))
    order = [F.desc("dollars"), F.col("session_id")]
    top = found.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over `most` rows
    return top.crossJoin(total)  # one row


def comparison(lines: DataFrame) -> DataFrame:
    """(reported, comparison, state) of priced lines with a side: one row."""
    side = lambda s: F.sum(F.when((F.col("state") == "priced") & (F.col("side") == s), F.col("dollars")))
    both = lines.agg(side("reported").alias("reported"), side("comparison").alias("comparison"))
    return both.withColumn("state", F.when(F.col("reported").isNull() & F.col("comparison").isNull(), "nothing-priced").otherwise("compared"))
