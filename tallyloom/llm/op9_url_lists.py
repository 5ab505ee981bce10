"""URL filters as of the time of fetching: dated list entries become validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import as_id
from tallyloom.shared import cut

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: Seconds of the smallest block of time, and powers of two of it that are blocks as well (2^27 minutes: to the year 2225).
UNIT, LEVELS = 60, 27
#: Patterns (some 100 bytes each) up to which the list of them is broadcast.
MOST_PATTERNS = 50_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, valid_from, valid_to): entries is (kind, pattern, category, action, listed_at).

    An 'add' is valid until the next entry of the same kind, pattern and category, or for ever (null). Of entries of
    one moment a 'remove' comes last, so what is added and removed at once is never valid.
    """
    w = Window.partitionBy("kind", "pattern", "category").orderBy("listed_at", "action")
    return (
        entries.withColumn("listed_at", F.col("listed_at").cast("timestamp"))
        .filter("pattern is not null and listed_at is not null")
        .withColumn("valid_to", F.lead("listed_at").over(w))
        .filter("action = 'add' and (valid_to is null or valid_to > listed_at)")
        .select("kind", "pattern", "category", F.col("listed_at").alias("valid_from"), "valid_to")
    )


def pieces(found: DataFrame, unit: int = UNIT) -> DataFrame:
    """intervals() in pieces (kind, pattern, category, level, block, valid_from, valid_to).

    A piece of level k is block number `block` of unit * 2^k seconds, wholly inside its interval; at most two of each
    level make up an interval's whole units. Level -1 is the unit that holds the interval's beginning or its end, with
    the times to compare. So a moment lies in exactly one piece of each interval that holds it, and it is found by
    equality with the moment's own blocks.
    """
    n = unit * 1_000_000
    from_, to = F.unix_micros("valid_from"), F.unix_micros("valid_to")
    low, high = F.expr(f"cast(-floor(-unix_micros(valid_from) / {n}) as bigint)"), F.coalesce(F.expr(f"cast(floor(unix_micros(valid_to) / {n}) as bigint)"), F.lit(1 << LEVELS))
    piece = lambda level, block: F.struct(F.lit(level).alias("level"), block.alias("block"))
    parts = [F.when(from_ % n != 0, piece(-1, F.col("low") - 1)), F.when((to % n != 0) & ((F.col("low") <= F.col("high")) | (from_ % n == 0)), piece(-1, F.col("high")))]
    for k in range(LEVELS + 1):
        left, right = F.negative(F.shiftright(F.negative(F.col("low")), k)), F.shiftright("high", k)
        odd = F.pmod(left, F.lit(2))
        parts += [F.when((left < right) & (odd == 1), piece(k, left)), F.when((F.pmod(right, F.lit(2)) == 1) & (left + odd < right), piece(k, right - 1))]
    made = found.withColumn("low", low).withColumn("high", high).withColumn("piece", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    return made.select("kind", "pattern", "category", "piece.level", "piece.block", "valid_from", "valid_to")


def keys_of(url: Column) -> Column:
    """What of a URL an entry may name.

    host: its host; domain: its host and the domains above it; label: each label of its host; prefix: host with each
    leading part of the path; path: each leading part of the path, on any host.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.when(count >= 2, F.transform(F.sequence(F.lit(1), count - 1), lambda k: F.array_join(F.slice(labels, k, count), ".")))
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, k), "/"))))
    of = lambda kind, keys: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("pattern")))
    return F.array_distinct(F.concat(of("host", F.array(host)), of("domain", domains), of("label", labels), of("prefix", F.transform(paths, lambda p: F.concat(host, p))), of("path", paths)))


def active_entries(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", unit: int = UNIT) -> DataFrame:
    """One row per row of captures: (page_id, url, host, fetched_at, n_active, blocked, first_reason).

    Every distinct (url, time) gives the few keys by which an entry may name it; those that the list has (see pieces)
    are joined by key, level and block of time with the pieces of the entries' intervals. Whole blocks are counted
    before the join, so each probe meets one row, and only the entries that begin or end in the capture's own minute
    are compared by their times. Neither a pattern with very many intervals nor a host with very many captures is
    compared in pairs: captures of one pattern are dealt by their time. The list of patterns is broadcast up to
    MOST_PATTERNS of them.

    Nulls: a null url or time matches nothing; a null id stays null. Empty url: matches nothing. Very long urls: one
    key per part of host and path. Ties: an entry is active from its moment on and no longer at the moment of its end.
    Repeated rows: each has its own result. Empty tables: no rows, or nothing blocked. Other columns are ignored.
    """
    c = captures.select(as_id(captures, id_col, "page_id"), captures[url_col].cast("string").alias("url"), captures[at_col].cast("timestamp").alias("fetched_at"))
    p = cut(pieces(intervals(entries), unit), "list-pieces")
    whole = p.filter("level >= 0").groupBy("kind", "pattern", "level", "block").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("reason"))
    edges = p.filter("level < 0").select("kind", "pattern", "block", "category", "valid_from", "valid_to")
    listed = cut(p.groupBy("kind", "pattern").agg(F.array_sort(F.collect_set("level")).alias("levels")), "list-patterns")
    if listed.count() <= MOST_PATTERNS:
        listed = F.broadcast(listed)
    keyed = c.select("url", "fetched_at").filter("url <> '' and fetched_at is not null").distinct().withColumn("key", F.explode(keys_of(F.col("url")))).select("url", "fetched_at", "key.kind", "key.pattern")
    minute = F.floor(F.unix_micros("fetched_at") / (unit * 1_000_000)).cast("long")
    probes = keyed.join(listed, ["kind", "pattern"]).withColumn("minute", minute).withColumn("level", F.explode("levels")).withColumn("block", F.expr("shiftright(minute, greatest(level, 0))")).drop("levels", "minute")
    in_whole = probes.filter("level >= 0").join(whole, ["kind", "pattern", "level", "block"]).select("url", "fetched_at", "n", "reason")
    inside = "valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)"
    in_edge = probes.filter("level < 0").drop("level").join(edges, ["kind", "pattern", "block"]).filter(inside).select("url", "fetched_at", F.lit(1).cast("long").alias("n"), F.col("category").alias("reason"))
    found = in_whole.unionByName(in_edge).groupBy("url", "fetched_at").agg(F.sum("n").alias("n"), F.min("reason").alias("reason"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return c.join(found, ["url", "fetched_at"], "left").select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at", n.alias("n_active"), (n > 0).alias("blocked"), F.col("reason").alias("first_reason"))
