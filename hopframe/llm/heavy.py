"""Guaranteed heavy hitters per group: Misra-Gries summaries as relations.

A summary holds at most `counters` keys of a group. To make one, the keys of a shard are ranked by weight and the
(counters + 1)-th weight is subtracted from all of them; what isn't positive afterwards goes. Whatever is subtracted
is subtracted from more than `counters` keys at once, so all that a group loses, over all its shards and rounds, is
at most T / (counters + 1) of its total weight T. Summaries of shards add up to one of their union, which is cut down
the same way, until a group has one summary:

    low = what is left of the key      high = low + what the group has subtracted      low <= w <= high

A key that isn't in the summary weighs no more than what was subtracted, so every key that can be heavy is in it, and
the exact weights of the few candidates come from a join with the sums.

Everything is DataFrame operations. Entries are summed before they are shuffled; a shard is a deal of the rows and a
slice of the keys, so it has SLICE sums on average however large its group is, and a key that is hot is one row of
each deal. Shards, and so the bounds, follow from the entries alone, not from how they are stored. Joins are merge
joins: no side is broadcast, since candidates and totals grow with the number of groups.

Entries with a null group, key or weight drop out, and so do those of negative weight (a summary bounds sums of what
isn't negative; zero counts as an entry). Repeated entries count again. A group without weight has no heavy key.
Equal weights at the cut go together, so ties don't depend on an order. Keys are text, of any length. Empty tables
give empty results; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

COUNTERS = 127
DEALS = 4
SLICE = 65_536  # sums in a shard's slice of keys
FAN = 64  # shards that are merged in a round
KEYS = ["stream", "grp"]


def sums(streams: list[DataFrame]) -> DataFrame:
    """Weights and numbers of entries (stream, grp, item, weight, deal) by group, key and deal; stored. Each stream is added
    up by its own kind of key, which becomes text afterwards."""
    added = None
    for entries in streams:
        kept = entries.where("stream is not null and grp is not null and item is not null and weight >= 0")
        one = kept.groupBy(*KEYS, "item", "deal").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).withColumn("item", F.col("item").cast("string"))
        added = one if added is None else added.union(one)
    return common.stage(added, "sums", "lz4")


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.scan_partitions(df))


def _cut(rows: DataFrame, counters: int) -> DataFrame:
    """Rank (stream, grp, shard, item, low, cut) in each shard, subtract, drop. The row at the place of the subtracted
    weight stays without its key and carries what the shard has lost; the order of equal weights doesn't matter, since
    equals of the subtracted weight all go."""
    shard = Window.partitionBy(*KEYS, "shard").orderBy(F.desc("low"))
    whole = shard.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.withColumn("place", F.row_number().over(shard)).withColumn("less", F.coalesce(F.nth_value("low", counters + 1).over(whole), F.lit(0)))
    left = F.col("low") - F.col("less")
    carries = (F.col("place") == counters + 1) & F.col("item").isNotNull()
    stays = ranked.where(F.col("item").isNull() | (left > 0) | carries)
    named = F.when(~carries, F.col("item"))
    return stays.select(*KEYS, "shard", named.alias("item"), F.when(named.isNull(), 0).otherwise(left).cast("long").alias("low"), F.when(carries, F.col("less")).otherwise(F.col("cut")).cast("long").alias("cut"))


def summaries(added: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(stream, grp, item, low, high) of each group's summary; `added` as `sums` has stored it."""
    n = added.count()
    slices = max(1, -(-n // SLICE))
    part = F.pmod(F.conv(F.substring(F.md5("item"), 1, 8), 16, 10).cast("long"), F.lit(slices))
    tasks = _tasks(added)
    rows = added.select(*KEYS, (F.col("deal") * slices + part).alias("shard"), "item", F.col("w").alias("low"), F.lit(0).cast("long").alias("cut"))
    rows = _cut(rows.repartition(tasks, *KEYS, "shard"), counters)
    shards = slices * DEALS
    while shards > 1:
        shards = -(-shards // FAN)
        met = rows.withColumn("shard", F.expr(f"shard div {FAN}")).repartition(tasks, *KEYS, "shard")
        rows = _cut(met.groupBy(*KEYS, "shard", "item").agg(F.sum("low").alias("low"), F.sum("cut").alias("cut")), counters)
    lost = F.sum("cut").over(Window.partitionBy(*KEYS, "shard"))
    return rows.withColumn("lost", lost).where("item is not null").select(*KEYS, "item", "low", (F.col("low") + F.col("lost")).alias("high"))


def heavy_hitters(entries: DataFrame | list[DataFrame], share: int, counters: int = COUNTERS) -> DataFrame:
    """The keys that weigh more than 1/share of their group: stream, grp, item, n_entries, total, w and the summary's
    low, estimate, high. entries: (stream, grp, item, weight, deal), or several such tables of different streams; deal is
    any number from 0 to DEALS - 1 that deals a key's entries out. counters must be at least `share`."""
    if counters < share:
        raise ValueError("a summary needs at least as many counters as the share asks for")
    added = sums(entries if isinstance(entries, list) else [entries])
    totals = added.groupBy(*KEYS).agg(F.sum("n").alias("n_entries"), F.sum("w").alias("total"))
    near = summaries(added, counters).hint("merge").join(totals, KEYS).where(F.lit(share) * F.col("high") > F.col("total"))
    exact = added.groupBy(*KEYS, "item").agg(F.sum("w").alias("w"))
    found = near.hint("merge").join(exact, [*KEYS, "item"]).where(F.lit(share) * F.col("w") > F.col("total"))
    return found.select(*KEYS, "item", "n_entries", "total", "w", "low", F.expr("low + (high - low) div 2").alias("estimate"), "high")


def _dealt(number: Column) -> Column:
    return F.coalesce(F.pmod(number, F.lit(DEALS)), F.lit(0)).cast("int")


def _quarter_day(df: DataFrame, ts: str) -> Column:
    """Quarters of a day since 1970 of a time that is read as UTC, whatever the session's zone."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.expr(f"cast(floor(unix_micros({ts}) / {6 * 3_600_000_000}) as long)")
    return F.expr(f"cast(unix_date(cast({ts} as date)) * 4 + hour({ts}) div 6 as long)")


def json_keys(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """The columns and a row for each `key` in a column of JSON texts: `os=`, `tag=` and `sku=`. None for texts that aren't
    valid JSON from end to end, or repeat a key of an object. The parser stops after the first value, so the text is
    parsed inside a list, which must then have one member, and inside an object: what follows a value ends one of the
    two too early. Only an object has such keys."""
    named = rows.where(F.col(text).rlike(r"device|tags|items|\\"))  # no other text has these names, plain or escaped
    whole = F.when(F.col(text).rlike(r"\}\s*\]"), F.expr(f"try_parse_json(concat('{{\"v\":', {text}, '}}')) is not null")).otherwise(True)  # a list can end early there alone
    parsed = named.select(*columns, F.expr(f"try_parse_json(concat('[', {text}, ']'))").alias("inside"), whole.alias("whole"))
    sound = parsed.where("inside is not null and whole and size(cast(inside as array<variant>)) = 1")
    empty = "cast(array() as array<string>)"
    keys = sound.select(
        *columns,
        F.expr("try_variant_get(inside, '$[0].device.os', 'string')").alias("os"),
        F.expr(f"coalesce(try_variant_get(inside, '$[0].tags', 'array<string>'), {empty})").alias("tags"),
        F.expr("coalesce(try_variant_get(inside, '$[0].items', 'array<variant>'), cast(array() as array<variant>))").alias("items"),
    )
    listed = F.expr("concat(array('os=' || os), transform(tags, t -> 'tag=' || t), transform(items, i -> 'sku=' || try_variant_get(i, '$.sku', 'string')))")
    return keys.select(*columns, F.explode(listed).alias("key"))


def shop_entries(spark, sf_dir: str) -> list[DataFrame]:
    """Clients per quarter of a day, items per vendor by quantity, and properties per client."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    entry = lambda df, stream, grp, item, weight, deal: df.select(F.lit(stream).alias("stream"), grp.cast("long").alias("grp"), item.alias("item"), weight.cast("long").alias("weight"), _dealt(deal).alias("deal"))
    one = F.lit(1)
    user = entry(clicks, "user", _quarter_day(clicks, "ts"), F.col("client_id"), one, F.col("click_id"))
    part = entry(lines, "part", F.col("vendor_id"), F.col("item_id"), F.col("quantity"), F.col("sale_id") + F.col("line_no"))
    keyed = json_keys(clicks.where("client_id is not null"), "props", "client_id", "click_id")
    prop = entry(keyed, "prop", F.col("client_id"), F.col("key"), one, F.col("click_id"))
    return [user, part, prop]


def op13_heavy_hitters(spark, sf_dir: str) -> DataFrame:
    """Keys that weigh more than a fiftieth of their group in three streams of the shop's tables."""
    return heavy_hitters(shop_entries(spark, sf_dir), 50)


_CUT_SQL = f"""
    select stream, grp, shard, case when not carries then item end as item,
           case when carries or item is null then 0 else low - less end as low,
           case when carries then less else cut end as cut
    from (select *, place = {COUNTERS + 1} and item is not null as carries
          from (select *, row_number() over s as place,
                       coalesce(nth_value(low, {COUNTERS + 1}) over (s rows between unbounded preceding and unbounded following), 0) as less
                from %s window s as (partition by stream, grp, shard order by item is null, low desc, item)) ranked) marked
    where item is null or low - less > 0 or carries"""

OP13_SQL = f"""
with entries as (
    select 'user' as stream, cast(floor(epoch_us(ts) / 21600000000.0) as bigint) as grp, cast(client_id as varchar) as item,
           cast(1 as bigint) as weight, coalesce(click_id % {DEALS}, 0) as deal
    from clicks
    union all
    select 'part', vendor_id, cast(item_id as varchar), cast(quantity as bigint), coalesce((sale_id + line_no) % {DEALS}, 0) from sale_lines
    union all
    select 'prop', client_id, unnest(case when json_valid(props) then
               ['os=' || json_extract_string(props, '$.device.os')]
               || ['tag=' || t for t in coalesce(json_extract_string(props, '$.tags[*]'), [])]
               || ['sku=' || t for t in coalesce(json_extract_string(props, '$.items[*].sku'), [])] end),
           1, coalesce(click_id % {DEALS}, 0)
    from clicks
), added as materialized (
    select stream, grp, item, deal, cast(sum(weight) as bigint) as w, count(*) as n
    from entries where grp is not null and item is not null and weight >= 0
    group by all
), slices as (
    select greatest(1, cast(ceil(count(*) / {SLICE}.0) as bigint)) as slices from added
), dealt as (
    select stream, grp, deal * slices + cast('0x' || substr(md5(item), 1, 8) as bigint) % slices as shard, item, w as low, 0 as cut
    from added, slices
), first as ({_CUT_SQL % "dealt"}
), met as (
    select stream, grp, 0 as shard, item, sum(low) as low, sum(cut) as cut from first group by stream, grp, item
), second as ({_CUT_SQL % "met"}
), summed as (
    select stream, grp, item, low, low + sum(cut) over (partition by stream, grp) as high from second
), totals as (
    select stream, grp, sum(n) as n_entries, sum(w) as total from added group by stream, grp
), exact as (
    select stream, grp, item, sum(w) as w from added group by stream, grp, item
)
select stream, grp, item, cast(n_entries as bigint) as n_entries, cast(total as bigint) as total, cast(w as bigint) as w,
       cast(low as bigint) as low, cast(low + (high - low) // 2 as bigint) as estimate, cast(high as bigint) as high
from summed join totals using (stream, grp) join exact using (stream, grp, item)
where 50 * w > total"""
