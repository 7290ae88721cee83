"""Mixing sources to target weights (8): Sainte-Laguë quotas of equal-token blocks, then a seeded choice of blocks.

1. A source's target is its weight's share of `share` times all words, but at most `cap` times its own words; what
   is over is shared again by weight (water filling, in closed form over the sources in order of cap / weight).
2. The targets are votes for round(total / block_words) seats. Sainte-Laguë gives each source its seats, and once
   more deals a source's seats to its shards by their words. Shards hold about shard_words each, so a source of any
   size is spread over tasks.
3. A shard lines its documents up in a seeded order and cuts the line into blocks of block_words. With q seats and n
   blocks, all blocks are taken q div n times, and q mod n of them once more: those that an affine permutation of the
   block numbers, with a seeded offset, puts first. No ranking of blocks is needed.

All of it is DataFrame work; the driver sees nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm.common import n_words, words

#: A prime; as no shard has as many blocks, its multiples visit every block number once.
PRIME = 2147483647


@dataclass(frozen=True)
class MixConfig:
    """weights: by the source's place in code-point order (null last), repeating."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    block_words: int = 64
    shard_words: int = 1_000_000
    seed: int = 7


def hex_number(text: Column) -> Column:
    """The first 8 hex digits of a text's md5 as a number; every engine has this hash."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """sources: key columns __null, __src, source_size. Adds place and target. A row per source, so one task will do."""
    order = Window.orderBy("__null", "__src")
    weights = F.array(*[F.lit(w) for w in config.weights])
    ranked = sources.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("place") % len(config.weights)).cast("int") + 1)
    )
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(all_rows) * config.share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * config.cap) / F.sum("weight").over(after)
    open_level = F.when(level * F.col("weight") <= F.col("source_size") * config.cap, level)
    filled = ranked.withColumn("__level", open_level).withColumn("__level", F.max("__level").over(all_rows))
    most = (F.col("source_size") * config.cap).cast("double")
    return filled.withColumn("target", F.least(most, F.coalesce(F.col("__level") * F.col("weight"), most))).drop("__level")


def sainte_lague(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str, quota: str) -> DataFrame:
    """Adds column quota: seats of each party in its group, by the highest quotients votes / (2 s + 1).

    A first divisor gives slightly too many seats; only the seats that may have to go, about two a party, are
    ranked by quotient. Ties go to the first in order. Without votes nobody has a seat.
    """
    whole = Window.partitionBy(*group)
    v, k = F.col(votes).cast("double"), F.col("__k")
    base = (
        parties.withColumn("__v", F.sum(v).over(whole))
        .withColumn("__k", F.count("*").over(whole))
        .withColumn("__hi", F.when(F.col("__v") > 0, F.floor(v * (F.col(seats) + k / 2) / F.col("__v") + 0.5)).otherwise(0))
        .withColumn("__lo", F.greatest(F.lit(0), F.col("__hi") - F.when(F.col("__v") > 0, F.ceil(v / F.col("__v") * k)).otherwise(0) - 2))
        .withColumn("__open", F.col(seats) - F.sum("__lo").over(whole))
    )
    offers = (
        base.where(F.col("__hi") > F.col("__lo"))
        .select(*group, *order, votes, "__open", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)).alias("__s"))
        .withColumn("__rank", F.row_number().over(whole.orderBy((v / (F.col("__s") * 2 + 1)).desc(), *order, "__s")))
        .where("__rank <= __open")
        .groupBy(*group, *order)
        .agg(F.count("*").alias("__won"))
    )
    return base.join(offers, [*group, *order], "left").withColumn(quota, F.col("__lo") + F.coalesce("__won", F.lit(0))).drop("__v", "__k", "__hi", "__lo", "__open", "__won")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, full, first, n_blocks, step, offset, extra and carry: a row per row of docs.

    A document's words stand at first, first + 1, ... of its shard's line; it is taken `full` times whole, and its
    words in the blocks k with (step * k + offset) mod n_blocks < extra once more. Null texts and texts without a
    word have size 0 and are never taken. Null sources are one source, last in order. Rows with equal ids are
    separate documents. An empty table gives an empty result.
    """
    b = config.block_words
    sized = docs.select(
        "doc_id",
        F.struct(*carry).alias("__c") if carry else F.lit(None).alias("__c"),
        F.col("source").isNull().alias("__null"),
        F.coalesce("source", F.lit("")).alias("__src"),
        n_words(F.col("text")).alias("size"),
    )
    key = ["__null", "__src"]
    sources = targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size")), config)
    sources = (
        sources.withColumn("__all", F.lit(0))
        .withColumn("__seats", F.round(F.sum("target").over(Window.partitionBy("__all")) / b).cast("long"))
        .withColumn("__shards", F.greatest(F.ceil(F.col("source_size") / config.shard_words), F.lit(1)))
    )
    sources = sainte_lague(sources, ["__all"], ["place"], "target", "__seats", "__blocks")
    placed = (
        sized.join(sources.select(*key, "place", "source_size", "target", "__shards", "__blocks"), key)
        .withColumn("__mix", F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
        .withColumn("__shard", F.conv(F.substring("__mix", 1, 8), 16, 10).cast("long") % F.col("__shards"))
    )
    shards = placed.groupBy("place", "__shard").agg(F.sum("size").alias("__words"), F.first("__blocks").alias("__blocks"))
    shards = (
        sainte_lague(shards, ["place"], ["__shard"], "__words", "__blocks", "__quota")
        .withColumn("n_blocks", F.greatest(F.ceil(F.col("__words") / b), F.lit(1)))
        .withColumn("__quota", F.least("__quota", F.col("n_blocks") * config.cap))
        .withColumn("step", F.lit(PRIME) % F.col("n_blocks"))
        .withColumn("offset", hex_number(F.concat_ws(":", F.lit("block"), F.lit(str(config.seed)), "place", "__shard")) % F.col("n_blocks"))
        .select("place", "__shard", "n_blocks", "step", "offset", F.expr("__quota div n_blocks").alias("full"), (F.col("__quota") % F.col("n_blocks")).alias("extra"))
    )
    line = Window.partitionBy("place", "__shard").orderBy("__mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("first", F.sum("size").over(line) - F.col("size")).join(shards, ["place", "__shard"])
    last = F.col("first") + F.col("size")
    part = F.aggregate(
        F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}")),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.when(chosen(k), F.least(last, (k + 1) * b) - F.greatest("first", k * b)).otherwise(0),
    )
    return lined.select(
        "doc_id",
        *[F.col("__c")[c].alias(c) for c in carry],
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("full") * F.col("size") + part).otherwise(0).alias("taken"),
        *["full", "first", "n_blocks", "step", "offset", "extra"],
    )


def chosen(block: Column) -> Column:
    """Whether a block is among those taken once more."""
    return (F.col("step") * block + F.col("offset")) % F.col("n_blocks") < F.col("extra")


def texts(mixed: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself from mix(..., carry=[... "text"]): each document as often as it is taken whole, then a row with
    its chosen blocks' words, joined by a space, if there are any. Other columns stay."""
    b = config.block_words
    part = F.filter("__w", lambda w, i: chosen(F.expr(f"first div {b}") * 0 + F.floor((F.col("first") + i) / b)))
    rest = F.col("taken") - F.col("full") * F.col("size")
    copies = F.array_repeat("text", F.when(F.col("size") > 0, F.col("full").cast("int")).otherwise(0))
    staged = mixed.withColumn("__w", F.when(rest > 0, words(F.col("text"))))
    pieces = F.when(rest > 0, F.array(F.array_join(part, " "))).otherwise(F.array().cast("array<string>"))
    return staged.withColumn("text", F.explode(F.concat(copies, pieces))).drop("__w")


#: DuckDB SQL for mix() with the default configuration.
SQL = r"""
with sized as (
  select doc_id, source is null as src_null, coalesce(source, '') as src,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size
  from documents),
s0 as (select src_null, src, sum(size)::bigint as source_size from sized group by all),
s1 as (select *, row_number() over (order by src_null, src) - 1 as place from s0),
s2 as (select *, [3, 1, 2][(place % 3 + 1)::int] as weight from s1),
s3 as (select *, ((sum(source_size) over ())::bigint * 1.5::double
         - coalesce(sum(source_size) over (order by source_size::double / weight, place rows between unbounded preceding and 1 preceding), 0)::bigint * 2)
         / (sum(weight) over (order by source_size::double / weight, place rows between current row and unbounded following))::bigint as level from s2),
s4 as (select *, max(case when level * weight <= source_size * 2 then level end) over () as lambda_ from s3),
s5 as (select *, least((source_size * 2)::double, coalesce(lambda_ * weight, (source_size * 2)::double)) as target,
         greatest(ceil(source_size / 1000000.0), 1)::bigint as shards from s4),
s6 as (select *, sum(target) over () as v, count(*) over () as k, round(sum(target) over () / 64)::bigint as seats from s5),
s7 as (select *, case when v > 0 then floor(target * (seats + k / 2.0::double) / v + 0.5)::bigint else 0 end as hi from s6),
s8 as (select *, greatest(0, hi - case when v > 0 then ceil(target / v * k)::bigint else 0 end - 2) as lo from s7),
s9 as (select *, seats - sum(lo) over () as open_ from s8),
o1 as (select place, open_, target, unnest(range(lo::bigint, hi::bigint)) as s from s9 where hi > lo),
o2 as (select place, open_, row_number() over (order by target / (s * 2 + 1) desc, place, s) as rnk from o1),
o3 as (select place, count(*) as won from o2 where rnk <= open_ group by place),
src as (select s9.*, lo + coalesce(won, 0) as blocks from s9 left join o3 using (place)),
placed as (
  select z.*, place, source_size, target, blocks, md5('7:' || coalesce(doc_id::varchar, 'null')) as mix,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % shards as shard
  from sized z join src using (src_null, src)),
h0 as (select place, shard, sum(size)::bigint as w, any_value(blocks) as seats from placed group by all),
h1 as (select *, (sum(w) over (partition by place))::double as v, count(*) over (partition by place) as k from h0),
h2 as (select *, case when v > 0 then floor(w * (seats + k / 2.0::double) / v + 0.5)::bigint else 0 end as hi from h1),
h3 as (select *, greatest(0, hi - case when v > 0 then ceil(w / v * k)::bigint else 0 end - 2) as lo from h2),
h4 as (select *, seats - sum(lo) over (partition by place) as open_ from h3),
q1 as (select place, shard, w, open_, unnest(range(lo::bigint, hi::bigint)) as s from h4 where hi > lo),
q2 as (select place, shard, open_, row_number() over (partition by place order by w::double / (s * 2 + 1) desc, shard, s) as rnk from q1),
q3 as (select place, shard, count(*) as won from q2 where rnk <= open_ group by all),
h5 as (select h4.*, greatest(ceil(w / 64.0), 1)::bigint as n_blocks, lo + coalesce(won, 0) as q0 from h4 left join q3 using (place, shard)),
h6 as (select *, least(q0, n_blocks * 2)::bigint as q, (2147483647 % n_blocks)::bigint as step,
         ('0x' || substr(md5('block:7:' || place || ':' || shard), 1, 8))::bigint % n_blocks as "offset" from h5),
h7 as (select place, shard, n_blocks, step, "offset", (q // n_blocks)::bigint as "full", (q % n_blocks)::bigint as extra from h6),
lined as (
  select p.*, h7.* exclude (place, shard),
         (sum(size) over (partition by p.place, p.shard order by mix, doc_id nulls first, size rows unbounded preceding) - size)::bigint as "first"
  from placed p join h7 on p.place = h7.place and p.shard = h7.shard)
select doc_id, size, source_size, target,
       case when size > 0 then "full" * size + coalesce(list_sum(list_transform(range("first" // 64, ("first" + size - 1) // 64 + 1),
         lambda b: case when (step * b + "offset") % n_blocks < extra then least("first" + size, (b + 1) * 64) - greatest("first", b * 64) else 0 end)), 0)
       else 0 end::bigint as taken,
       "full", "first", n_blocks, step, "offset", extra
from lined
"""
