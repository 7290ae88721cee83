"""Queries over embeddings as windows: probes, clusters, ranks and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import embedding_studies as e
from marketflow.operators import folds as fo
from marketflow.operators import probes as p
from marketflow.registry import query, view
from marketflow.sources import adapters as a
from marketflow.sources.shared import written

BY, KEY = ["symbol", "horizon"], ["pos"]


def windows(spark, sf_dir):
    """symbol, pos, label, x: an embedding is a window of one of five symbols."""
    return a.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("S"), F.col("vec_id") % 5).alias("symbol"), F.floor(F.col("vec_id") / 5).alias("pos"), F.col("label"), F.col("embedding").alias("x"))


def probe_rows(spark, sf_dir):
    """Rows of every symbol and horizon with y, the parity of the label so many windows ahead, and three walk-forward folds with an embargo."""
    w = windows(spark, sf_dir)
    ahead = w.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col("pos") - h).alias("pos")) for h in (0, 1, 5)])).alias("r"), (F.col("label") % 2).alias("y")).select("symbol", "r.*", "y")
    rows = w.join(ahead, ["symbol", "pos"])
    folds = fo.walk_forward_folds(w.groupBy("symbol").agg((F.max("pos") + 1).alias("n")), ["symbol"], 3, 2, 20, 3)
    own = folds.groupBy("symbol").agg(F.collect_list(F.struct("fold", "role", "first", "last")).alias("f"))
    inside = lambda role: F.transform(F.filter("f", lambda s: (s["role"] == role) & F.col("pos").between(s["first"], s["last"])), lambda s: s["fold"].cast("int"))
    return rows.join(own, "symbol").select(*BY, *KEY, "x", "y", inside("train").alias("train"), inside("test").alias("test"))


@query("probe_eval")
def probe_eval(spark, sf_dir):
    """Standardised features, 20 components, logistic regression, for each symbol, horizon and fold."""
    return p.probe_eval(probe_rows(spark, sf_dir), BY, KEY)


@query("probe_controls")
def probe_controls(spark, sf_dir):
    """The larger class, a random projection, and labels permuted within a symbol and horizon."""
    rows = probe_rows(spark, sf_dir)
    mixed = fo.shuffled_within(rows, BY, "pos", "y", 7).withColumn("y", F.col("shuffled")).drop("shuffled")
    out = [p.probe_eval(x, BY, KEY, p.ProbeConfig(how)).withColumn("control", F.lit(name)) for name, how, x in (("majority", "majority", rows), ("random_projection", "random", rows), ("shuffled", "pca", mixed))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("probe_summary")
def probe_summary(spark, sf_dir):
    """R2: what the symbols' probes of a horizon reach together."""
    return p.probe_summary(p.probe_eval(probe_rows(spark, sf_dir), BY, KEY), ["horizon"])


@query("probe_scores")
def probe_scores(spark, sf_dir):
    """The score of every tested window by the model that has not seen it, with classes that weigh the same."""
    x = p.prepared(probe_rows(spark, sf_dir), BY, KEY)
    return p.out_of_fold(x, p.fit(x, p.ProbeConfig("none", balanced=True)), BY, KEY)


@query("probe_grid")
def probe_grid(spark, sf_dir):
    """Three strengths of the penalty, and which does best."""
    return p.grid(probe_rows(spark, sf_dir).where("horizon = 0"), BY, KEY, [0.01, 0.1, 1.0], p.ProbeConfig(balanced=True))


@query("session_confound")
def session_confound(spark, sf_dir):
    """Features against the hour alone."""
    rows = probe_rows(spark, sf_dir).where("horizon < 5").withColumn("hour", (F.col("pos") % 24).cast("int"))
    return p.confound(rows, BY, KEY, "hour", p.ProbeConfig())


@query("cluster_agreement")
def cluster_agreement(spark, sf_dir):
    """K-means of the embeddings, and how far clusters agree with three labels beyond permuted ones."""
    x = a.table(spark, sf_dir, "embeddings").withColumns({"even": (F.col("label") % 2).cast("int"), "low": (F.col("label") < 3).cast("int")})
    x = written(e.k_means(x, "vec_id", "embedding", e.ClusterConfig(k=16)).select("vec_id", "cluster", "label", "even", "low"))
    out = [e.agreement(x, "vec_id", "cluster", c, 50).withColumn("name", F.lit(c)) for c in ("label", "even", "low")]
    return out[0].unionByName(out[1]).unionByName(out[2])


_ARI = """select replicate, case when (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) then 1.0::double else (s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) end as ari from
    (select replicate, sum(n * (n - 1) / 2.0::double) as s, sum(n)::double as n from {0} group by all) join (select replicate, sum(n * (n - 1) / 2.0::double) as sa from (select replicate, c, sum(n) as n from {0} group by all) group by all) using (replicate)
    join (select replicate, sum(n * (n - 1) / 2.0::double) as sb from (select replicate, label, sum(n) as n from {0} group by all) group by all) using (replicate)"""
view("dealt", "select vec_id, (vec_id + label // 2) % 7 as c, label from embeddings")
view("real_cells", "select 0 as replicate, c, label, count(*) as n from dealt group by all", ["dealt"])
view("null_cells", "select replicate, c, d.label, count(*) as n from (select replicate, c, row_number() over (partition by replicate order by md5('3:' || replicate || ':' || vec_id), vec_id) as r from dealt, range(1, 41) t(replicate)) join (select label, row_number() over (order by label) as r from dealt) d using (r) group by all", ["dealt"])


@query("agreement_null", f"select r.ari, null_mean, null_p95, null_p99, null_max from ({_ARI.format('real_cells')}) r, (select avg(ari) as null_mean, quantile_cont(ari, 0.95) as null_p95, quantile_cont(ari, 0.99) as null_p99, max(ari) as null_max from ({_ARI.format('null_cells')}))", ["real_cells", "null_cells"], "ari null_mean null_p95 null_p99 null_max")
def agreement_null(spark, sf_dir):
    """A labeling against another, and against its permutations."""
    x = a.table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") + F.floor(F.col("label") / 2)) % 7).alias("c"), "label")
    return e.agreement(x, "vec_id", "c", "label", 40, 3)


@query("embedding_rank")
def embedding_rank(spark, sf_dir):
    """Rank of all embeddings, of their first 16 components four times over, and of one vector repeated."""
    x = a.table(spark, sf_dir, "embeddings")
    part = F.slice("embedding", 1, 16)
    least = x.agg(F.min_by("embedding", "vec_id").alias("embedding"))
    sets = {"all": x, "repeated_components": x.select(F.concat(part, part, part, part).alias("embedding")), "one_vector": x.select("vec_id").join(F.broadcast(least))}
    out = [e.rank_summary(t, "embedding").withColumn("name", F.lit(n)) for n, t in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_CAP = 2000
view("emb_rows", "select label as symbol, vec_id // 10 % 24 as hour, vec_id, embedding::double[] as v, row_number() over (order by label, vec_id // 10 % 24, vec_id) - 1 as place, row_number() over (partition by vec_id // 10 % 24 order by label, vec_id) - 1 as hour_place from embeddings")
view(
    "emb_cells",
    """select *, sum(w0) over w as to0, sum(w1) over w as to1, sum(w2) over w as to2, sum(w3) over w as to3 from (select *, n * (n - 1) // 2 as w0, n * in_symbol as w1, n * in_hour as w2, n * (first - in_symbol) as w3, first - in_symbol as others from (
    select symbol, hour, n, coalesce(sum(n) over (order by symbol, hour rows between unbounded preceding and 1 preceding), 0)::bigint as first, coalesce(sum(n) over (partition by symbol order by hour rows between unbounded preceding and 1 preceding), 0)::bigint as in_symbol,
    coalesce(sum(n) over (partition by hour order by symbol rows between unbounded preceding and 1 preceding), 0)::bigint as in_hour from (select symbol, hour, count(*) as n from emb_rows group by all))) window w as (order by symbol, hour)""",
    ["emb_rows"],
)
view(
    "emb_totals",
    f"select *, case when k < 3 then least({_CAP}, p) when q > 0 then least(p, 20 * {_CAP}, ceil(least({_CAP}, q) * p::double / q)::bigint) else 0 end::bigint as wanted from (select unnest([0, 1, 2, 3]) as k, unnest([sum(w0), sum(w1), sum(w2), sum(w3)])::bigint as p, (sum(w3) - sum(w2))::bigint as q from emb_cells)",
    ["emb_cells"],
)
view(
    "emb_draws",
    """select k, t, case when wanted = p then t else least((lo + floor(('0x' || substr(md5('5:' || k || ':' || t), 1, 8))::bigint::double / 4294967296 * (hi - lo)))::bigint, p - 1) end as u
    from (select *, floor(t / wanted::double * p) as lo, floor((t + 1) / wanted::double * p) as hi from emb_totals, range(40000) r(t) where t < wanted)""",
    ["emb_totals"],
)
_R = "select d.k, c.*, u - (to{0} - w{0}) as r from emb_draws d join emb_cells c on d.k = {0} and u >= to{0} - w{0} and u < to{0}"
view(
    "emb_pairs",
    f"""select 'same_symbol_same_hour' as population, x.v as x, y.v as y from (select *, unnest(range(1, n)) as i from ({_R.format(0)})) z join emb_rows x on x.place = z.first + z.i join emb_rows y on y.place = z.first + z.r - z.i * (z.i - 1) // 2 where z.r >= z.i * (z.i - 1) // 2 and z.r < (z.i + 1) * z.i // 2
    union all select 'same_symbol_other_hour', x.v, y.v from ({_R.format(1)}) z join emb_rows x on x.place = z.first + z.r // z.in_symbol join emb_rows y on y.place = z.first - z.in_symbol + z.r % z.in_symbol
    union all select 'other_symbol_same_hour', x.v, y.v from ({_R.format(2)}) z join emb_rows x on x.place = z.first + z.r // z.in_hour join emb_rows y on y.hour = z.hour and y.hour_place = z.r % z.in_hour
    union all select 'other_symbol_other_hour', x.v, y.v from ({_R.format(3)}) z join emb_rows x on x.place = z.first + z.r // z.others join emb_rows y on y.place = z.r % z.others where x.hour <> y.hour""",
    ["emb_draws", "emb_cells", "emb_rows"],
)


@query("cosine_populations", "select population, count(*) as n_pairs, avg(c) as mean, coalesce(stddev_samp(c), 0) as std, quantile_cont(c, 0.05) as p5, quantile_cont(c, 0.5) as p50, quantile_cont(c, 0.95) as p95 from (select population, list_cosine_similarity(x, y) as c from emb_pairs) group by population", ["emb_pairs"], "mean std p5 p50 p95")
def cosine_populations(spark, sf_dir):
    """Cosines of pairs of the same symbol or not, the same hour or not."""
    x = a.table(spark, sf_dir, "embeddings").select(F.col("label").alias("symbol"), (F.floor(F.col("vec_id") / 10) % 24).alias("hour"), "vec_id", "embedding")
    return e.cosine_populations(x, "symbol", "hour", "vec_id", "embedding", _CAP, 5)
