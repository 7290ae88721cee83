"""Queries over samples, folds, masks, attributions and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketflow.operators import evaluation as v
from marketflow.operators import event_features as ef
from marketflow.operators import folds as fo
from marketflow.operators import order_events as o
from marketflow.operators import row_bootstrap as rb
from marketflow.plans.feature_queries import event_table as features
from marketflow.registry import query, view
from marketflow.sources import adapters as a

view(
    "sc",
    """select event_type as symbol, event_id as id, event_ts_ms, event_ts_ms // 86400000 as day, k as score, (value > 60 or (value > 40 and k > 50))::int as label, value - 50 as ret,
    'U' || user_id as account, (value / 100 + k / 37.0::double) as proba from ev""",
    ["ev"],
)


def _sc(spark, sf_dir):
    e = a.events(spark, sf_dir)
    label = ((F.col("value") > 60) | ((F.col("value") > 40) & (F.col("k") > 50))).cast("int")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), "event_ts_ms", F.expr("event_ts_ms div 86400000").alias("day"), F.col("k").alias("score"), label.alias("label"), (F.col("value") - 50).alias("ret"),
        F.concat(F.lit("U"), F.col("user_id")).alias("account"), (F.col("value") / 100 + F.col("k") / 37.0).alias("proba"),
    )


_H = lambda seed, key="id": f"md5('{seed}:' || {key})"


@query("equal_symbol_sample", f"select symbol, id from (select *, row_number() over (partition by symbol order by {_H(3)}, id) as r from sc) where r <= (select min(n) from (select count(*) as n from sc group by symbol))", ["sc"])
def equal_symbol_sample(spark, sf_dir):
    """K9: as many rows of every symbol as the smallest has."""
    return fo.equal_sample(_sc(spark, sf_dir), "symbol", "id", 3).select("symbol", "id")


@query("stratified_split", f"select symbol, label, id, case when r <= floor(count(*) over (partition by symbol, label) * 0.8::double) then 'train' else 'test' end as role from (select *, row_number() over (partition by symbol, label order by {_H(4)}, id) as r from sc) where r <= 200", ["sc"])
def stratified_split(spark, sf_dir):
    """Up to 200 rows of each class, four fifths to train."""
    return fo.stratified_split(_sc(spark, sf_dir), ["symbol", "label"], "id", 4, 200).select("symbol", "label", "id", "role")


_FOLDS = """select symbol, fold, case role when 0 then 'train' else 'test' end as role, case when role = 1 then s else greatest(s - 50 - 300, 0) end as first, case when role = 1 then s + t - 1 else s - 51 end as last from (
    select symbol, fold, role, t, fold * t + 350 as s from (select *, (n - 350) // 4 as t from (select symbol, count(*) as n from sc group by symbol)) , range(4) f(fold), range(2) r(role) where n >= 350 + 4 * 20)"""
view("wff", _FOLDS, ["sc"])


def _wff(spark, sf_dir):
    return fo.walk_forward_folds(_sc(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n")), ["symbol"], 4, 50, 300, 20, rolling=True)


@query("walk_forward_folds", "select * from wff", ["wff"])
def walk_forward_folds(spark, sf_dir):
    """Rolling folds with an embargo, as ranges of positions."""
    return _wff(spark, sf_dir)


@query("fold_returns", "select symbol, fold, role, count(*) as n, sum(ret) as ret from (select *, row_number() over (partition by symbol order by event_ts_ms, id) - 1 as pos from sc) join wff using (symbol) where pos between first and last group by all", ["sc", "wff"], "ret")
def fold_returns(spark, sf_dir):
    """Rows of each fold and role."""
    x = _sc(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("event_ts_ms", "id")) - 1)
    return fo.in_folds(x, _wff(spark, sf_dir), ["symbol"], "pos").groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.sum("ret").alias("ret"))


view("dayf", "select day, case when i < extra * (base + 1) then i // (base + 1) else extra + (i - extra * (base + 1)) // base end::int as fold from (select day, row_number() over (order by day) - 1 as i, count(*) over () // 5 as base, count(*) over () % 5 as extra from (select distinct day from sc))", ["sc"])


@query("day_folds", "select * from dayf", ["dayf"])
def day_folds(spark, sf_dir):
    """Five contiguous folds of days."""
    return fo.day_folds(_sc(spark, sf_dir), "day", 5)


@query(
    "embargoed_training",
    """select held_out, count(*) as n, sum(ret) as ret from (select s.*, fold, row_number() over (partition by s.day order by event_ts_ms, id) - 1 as pos, count(*) over (partition by s.day) as m, max(s.day) over (partition by fold) as last_day, min(s.day) over (partition by fold) as first_day
    from sc s join dayf using (day)) x, range(5) h(held_out) where held_out <> fold and not (day = last_day and pos >= m - 20 and held_out = fold + 1) and not (day = first_day and pos < 20 and held_out = fold - 1) group by held_out""",
    ["sc", "dayf"],
    "ret",
)
def embargoed_training(spark, sf_dir):
    """Rows to train on for each held-out fold, without its neighbours' nearest 20."""
    x = _sc(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("day").orderBy("event_ts_ms", "id")) - 1)
    return fo.embargoed_training(x, fo.day_folds(x, "day", 5), "day", "pos", 20).groupBy("held_out").agg(F.count("*").alias("n"), F.sum("ret").alias("ret"))


@query("leave_one_day_out", "select a.day as held, b.day, case when a.day = b.day then 'test' else 'train' end as role, b.n from (select distinct day from sc) a, (select day, count(*) as n from sc group by day) b", ["sc"])
def leave_one_day_out(spark, sf_dir):
    """Each day held out once."""
    return fo.leave_one_day_out(_sc(spark, sf_dir), "day")


@query("shuffled_labels", f"select a.id, a.label, b.label as shuffled from (select *, row_number() over (partition by day order by id) as r from sc) a join (select *, row_number() over (partition by day order by {_H(6)}, id) as r from sc) b on a.day = b.day and a.r = b.r", ["sc"])
def shuffled_labels(spark, sf_dir):
    """Labels permuted within days."""
    return fo.shuffled_within(_sc(spark, sf_dir), ["day"], "id", "label", 6).select("id", "label", "shuffled")


@query("random_controls", "select control_id, count(*) as sampled_rows, sum(ret) as net_pnl_bps from (select *, row_number() over (partition by control_id order by md5('9:' || control_id || ':' || id), id) as r from sc, range(1, 21) t(control_id)) where r <= 500 group by control_id", ["sc"], "net_pnl_bps")
def random_controls(spark, sf_dir):
    """Sums of random samples of the same size."""
    x = _sc(spark, sf_dir)
    return fo.random_controls(x, "id", "ret", 500, 20, 9).withColumn("control_id", F.col("control_id").cast("long"))


@query("session_buckets", "select symbol, (event_ts_ms // 3600000 % 24)::int as hour, (event_ts_ms // 3600000 % 24 // 4)::int as bucket, count(*) as n, avg(label) as rate from sc group by all", ["sc"], "rate")
def session_buckets(spark, sf_dir):
    """Label rates by UTC hour and four-hour bucket."""
    hour, bucket = fo.session_bucket(F.col("event_ts_ms"))
    return _sc(spark, sf_dir).groupBy("symbol", hour.alias("hour"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("label").alias("rate"))


@query("calendar_masks", "select symbol, count(*) as n from sc where day between (select min(day) from sc) + 5 and (select min(day) from sc) + 12 group by symbol", ["sc"])
def calendar_masks(spark, sf_dir):
    """Rows of a range of days."""
    x = _sc(spark, sf_dir)
    first = x.agg(F.min("day")).first()[0] or 0
    return fo.between_dates(x, "day", first + 5, first + 12).groupBy("symbol").agg(F.count("*").alias("n"))


@query("top_mask", "select id, row_number() over (partition by symbol order by proba desc, id) <= greatest(1, floor(count(*) over (partition by symbol) * 0.05::double)) as top from sc", ["sc"])
def top_mask(spark, sf_dir):
    """The first twentieth of each symbol by score."""
    return v.top_mask(_sc(spark, sf_dir), ["symbol"], "proba", "id", 0.05).select("id", "top")


@query("daily_top_mask", "select id, proba > q as top from sc join (select day, quantile_cont(proba, 0.95) as q from sc group by day) using (day)", ["sc"])
def daily_top_mask(spark, sf_dir):
    """Scores above their day's 95 % quantile."""
    return v.above_daily_quantile(_sc(spark, sf_dir), ["day"], "proba", 0.05).select("id", "top")


@query(
    "quintiles",
    "select id, greatest(1, (proba > e[1])::int + (proba > e[2])::int + (proba > e[3])::int + (proba > e[4])::int + (proba > e[5])::int) as quintile from sc join (select symbol, day, quantile_cont(proba, [0.0, 0.2, 0.4, 0.6, 0.8]) as e, count(*) as n from sc group by all) using (symbol, day) where n >= 5 union all select id, 0 from sc join (select symbol, day, count(*) as n from sc group by all) using (symbol, day) where n < 5",
    ["sc"],
)
def quintiles(spark, sf_dir):
    """Quintiles of each symbol's day."""
    return v.quintiles(_sc(spark, sf_dir), ["symbol", "day"], "proba").select("id", "quintile")


@query("precision_at_top", "select symbol, count(*) filter (t) as n_top, avg(label) filter (t) as precision, sum(label) filter (t) / nullif(sum(label), 0)::double as recall, avg(label) as base_rate, avg(label) filter (t) / avg(label) as lift from (select *, row_number() over (partition by symbol order by proba desc, id) <= greatest(1, round_even(count(*) over (partition by symbol) * 0.05::double, 0)) as t from sc) group by symbol", ["sc"], "precision recall base_rate lift")
def precision_at_top(spark, sf_dir):
    """Precision, recall and lift of the first twentieth."""
    return v.precision_at_top(_sc(spark, sf_dir), ["symbol"], "proba", "label", "id", 0.05)


view("fw", "select *, sum(ret) over (partition by account order by event_ts_ms, id) as c from sc", ["sc"])


@query("forward_returns", "select id, lead(c, 5) over w - c as fwd_5, lead(c, 20) over w - c as fwd_20, case when lead(c, 5) over w is null then -1 when lead(c, 5) over w - c > 0 then 1 else 0 end as direction from fw window w as (partition by account order by event_ts_ms, id)", ["fw"], "fwd_5 fwd_20")
def forward_returns(spark, sf_dir):
    """Sums of the next returns, and their sign."""
    x = v.forward_log_return(_sc(spark, sf_dir), ["account"], ["event_ts_ms", "id"], "ret", [5, 20])
    return x.select("id", "fwd_5", "fwd_20", v.realized_direction(F.col("fwd_5")).alias("direction"))


view("updown", "select symbol, day, sum((ret > 0)::int)::bigint as up, sum((ret < 0)::int)::bigint as down from sc group by all", ["sc"])
view("rates", "select *, n_up / (n_up + n_down)::double as rate from (select symbol, day, sum(up) over w as n_up, sum(down) over w as n_down, count(*) over w as n_days from updown window w as (partition by symbol order by day range between 6 preceding and current row)) where n_days >= 5 and n_up + n_down > 0", ["updown"])


def _rates(spark, sf_dir):
    d = _sc(spark, sf_dir).groupBy("symbol", "day").agg(F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"))
    return v.rolling_rate(d, "symbol", "day", "up", "down", 7, 5)


@query("rolling_rate", "select * from rates", ["rates"], "rate")
def rolling_rate(spark, sf_dir):
    """Rate of ups over a range of days."""
    return _rates(spark, sf_dir)


@query("rate_swing", "select *, case when swing <= 0.05 then 'STATIONARY' else 'DRIFTING' end as verdict from (select symbol, min(rate) as low, max(rate) as high, max(rate) - min(rate) as swing from rates group by symbol)", ["rates"], "low high swing")
def rate_swing(spark, sf_dir):
    """How far a rolling rate swings."""
    return v.rate_swing(_rates(spark, sf_dir), "symbol", "rate", 0.05)


_AUC = lambda by, src: f"select {by}, sum(p * (b + n / 2.0::double)) / nullif(sum(p) * sum(n), 0)::double as auc from (select *, coalesce(sum(n) over (partition by {by} order by score rows between unbounded preceding and 1 preceding), 0) as b from (select {by}, score, sum(p) as p, sum(n) as n from {src} group by all)) group by {by}"
view("dcounts", "select day, score, sum(label)::bigint as p, sum(1 - label)::bigint as n from sc group by all", ["sc"])


@query(
    "leave_one_out_auc",
    f"""select o.day, positives, o.auc, w.auc as auc_without, a.auc - w.auc as drop from ({_AUC('day', 'dcounts')}) o join (select day, sum(p)::bigint as positives from dcounts group by day) using (day)
    join ({_AUC('day', '(select d.day, c.score, c.p, c.n from (select distinct day from dcounts) d join dcounts c on c.day <> d.day)')}) w on w.day = o.day, ({_AUC('k', '(select 0 as k, * from dcounts)')}) a""",
    ["dcounts"],
    "auc auc_without drop",
)
def leave_one_out_auc(spark, sf_dir):
    """What each day adds to the area under the curve."""
    return v.leave_one_out_auc(_sc(spark, sf_dir), "day", "score", "label")


view("draws", "select replicate, day, count(*) as times from (select replicate, ('0x' || substr(md5('8:' || replicate || ':' || k), 1, 8))::bigint % n as i from range(1, 101) r(replicate), range(1, 1000) t(k), (select count(distinct day) as n from sc) where k <= n) join (select day, row_number() over (order by day) - 1 as i from (select distinct day from sc)) using (i) group by all", ["sc"])


@query(
    "bootstrap_mean",
    """select (select avg(ret) from sc) as mean, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high, avg((m <= 0)::int::double) as p_one_sided from (select replicate, sum(times * s) / sum(times * n) as m from draws join (select day, sum(ret) as s, count(*) as n from sc group by day) using (day) group by replicate)""",
    ["draws"],
    "mean low high p_one_sided",
)
def bootstrap_mean(spark, sf_dir):
    """Mean with bounds from drawn days."""
    return v.clustered_bootstrap_mean(_sc(spark, sf_dir), "day", "ret", 100, 8)


@query("bootstrap_auc", f"select a.*, s.positives, s.negatives from ({_AUC('replicate', '(select replicate, score, p * times as p, n * times as n from dcounts join draws using (day))')}) a join (select replicate, sum(p * times)::bigint as positives, sum(n * times)::bigint as negatives from dcounts join draws using (day) group by replicate) s using (replicate)", ["dcounts", "draws"], "auc")
def bootstrap_auc(spark, sf_dir):
    """Area under the curve over drawn days."""
    return v.clustered_bootstrap_auc(_sc(spark, sf_dir), "day", "score", "label", 100, 8)


@query(
    "headroom_grid",
    "select id, acc as accuracy, (2 * acc - 1) * abs(ret) - (2 * 4.0::double + 2 * abs(score / 10.0::double)) as headroom_bps from sc, (values (0.55::double), (0.6::double), (1.0::double)) t(acc)",
    ["sc"],
    "headroom_bps",
)
def headroom_grid(spark, sf_dir):
    """Expected bps after costs at three accuracies."""
    x = _sc(spark, sf_dir)
    grid = F.array(*[F.struct(F.lit(p).alias("accuracy"), v.headroom(F.col("ret"), F.col("score") / 10, 4.0, p).alias("headroom_bps")) for p in (0.55, 0.6, 1.0)])
    return x.select("id", F.explode(grid).alias("g")).select("id", "g.accuracy", "g.headroom_bps")


@query("burst_outcomes", "select id, sign(ret) * f as gross_continuation_bps, -(sign(ret) * f) as gross_reversion_bps, -(sign(ret) * f) - 8 as net_reversion_bps, coalesce(-(sign(ret) * f) - 8 > 0, false) as net_reversion_positive from (select id, ret, (lead(c, 5) over (partition by account order by event_ts_ms, id) - c) / 10000 * 10000 as f from fw)", ["fw"], "gross_continuation_bps gross_reversion_bps net_reversion_bps")
def burst_outcomes(spark, sf_dir):
    """Continuation and reversion after a move."""
    x = v.forward_log_return(_sc(spark, sf_dir), ["account"], ["event_ts_ms", "id"], "ret", [5])
    return x.select("id", *[c.alias(n) for n, c in v.burst_metrics(F.col("ret"), F.col("fwd_5") / 10_000, 8.0).items()])


@query("stress_scores", "select id, least(score / 100.0::double, 2) + least(greatest(ret, 0) / 100, 5) + least(coalesce(abs(case when score % 7 <> 0 then ret end) / 100, 0), 5) + least(abs(proba) / 100, 5) as stress from sc", ["sc"], "stress")
def stress_scores(spark, sf_dir):
    """A capped sum of four signs of stress."""
    c = F.col
    return _sc(spark, sf_dir).select("id", v.stress_score(c("score"), c("ret"), F.when(c("score") % 7 != 0, c("ret")), c("proba")).alias("stress"))


@query(
    "risk_states",
    "select s, count(*) as n from (select case when score % 11 = 0 then 'REFERENCE_MISSING' when score >= 75 and ret <= -25 then 'HIGH_VOL_RISK_OFF' when score >= 75 and ret >= 25 then 'HIGH_VOL_RISK_ON' when score >= 75 then 'HIGH_VOL_NEUTRAL' when ret >= 25 then 'RISK_ON' when ret <= -25 then 'RISK_OFF' else 'RISK_NEUTRAL' end as s from sc) group by s",
    ["sc"],
)
def risk_states(spark, sf_dir):
    """Classes of reference bars, counted."""
    c = F.col
    return _sc(spark, sf_dir).select(v.risk_state(c("score") % 11 != 0, c("ret"), c("score"), 75.0, -25.0, 25.0).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


@query("best_levels", "select snap_id, arg_min(bid, i) as best_bid, arg_min(ask, i) as best_ask from levels where bid > 0 and bid_qty > 0 group by snap_id", ["levels"], "best_bid best_ask")
def best_levels(spark, sf_dir):
    """Best bid and ask among levels with quantity."""
    bid, ask = v.best_levels(F.col("bids"), F.col("asks"))
    return a.book(spark, sf_dir).select("snap_id", bid.alias("best_bid"), ask.alias("best_ask"))


@query("row_identities", "select sha256(t) as digest, count(*) as n from (select 'symbol=' || event_type || '|score=' || case when k % 9 = 0 then '<NA>' else k::varchar end || '|account=U' || user_id as t from ev) group by t", ["ev"])
def row_identities(spark, sf_dir):
    """Rows by identity, with repeats."""
    x = _sc(spark, sf_dir).withColumn("score", F.when(F.col("score") % 9 != 0, F.col("score")))
    return x.groupBy(F.sha2(v.identity(["symbol", "score", "account"]), 256).alias("digest")).agg(F.count("*").alias("n"))


@query("latest_by_account", "select account, arg_max(id, (event_ts_ms, id)) as id, arg_max(score, (event_ts_ms, id)) as score from sc group by account", ["sc"])
def latest_by_account(spark, sf_dir):
    """The newest row of each key."""
    return v.latest_by(_sc(spark, sf_dir), "account", "event_ts_ms", "day", "id").select("account", "id", "score")


@query("diverse_top", "select symbol, id from (select *, row_number() over (partition by symbol order by event_ts_ms desc, id) > 1 as g from sc) order by g, event_ts_ms desc, id limit 20", ["sc"])
def diverse_top(spark, sf_dir):
    """L3: the newest of each symbol, then the newest of all."""
    return v.diverse_top(_sc(spark, sf_dir), "symbol", "event_ts_ms", "id", 20).select("symbol", "id")


@query("best_per_day", "select symbol, day, arg_max(id, (proba, id)) as id, max(proba) as proba from sc group by all order by proba desc, id limit 30", ["sc"], "proba")
def best_per_day(spark, sf_dir):
    """L4: the best of each symbol's day, then the best thirty."""
    x = _sc(spark, sf_dir).groupBy("symbol", "day").agg(F.max_by("id", F.struct("proba", "id")).alias("id"), F.max("proba").alias("proba"))
    return x.orderBy(F.desc("proba"), "id").limit(30)


@query(
    "contingency",
    "select *, (pairs_both - in_a * in_b / (n * (n - 1) / 2)) / ((in_a + in_b) / 2 - in_a * in_b / (n * (n - 1) / 2)) as ari from (select sum(c * (c - 1) / 2.0::double) as pairs_both, sum(c)::bigint as n from (select count(*) as c from sc group by symbol, score % 5)), (select sum(c * (c - 1) / 2.0::double) as in_a from (select count(*) as c from sc group by symbol)), (select sum(c * (c - 1) / 2.0::double) as in_b from (select count(*) as c from sc group by score % 5))",
    ["sc"],
    "ari pairs_both in_a in_b",
    digits=8,
)
def contingency(spark, sf_dir):
    """Agreement of two groupings."""
    return v.contingency(_sc(spark, sf_dir).withColumn("g", F.col("score") % 5), "symbol", "g").withColumnRenamed("both", "pairs_both")


@query("direction_asymmetry", "select symbol, avg((f > 0)::int::double) filter (label = 1) as up_given_label, avg((f > 0)::int::double) filter (label = 0) as up_given_none from (select *, lead(c, 5) over (partition by account order by event_ts_ms, id) - c as f from fw) where f is not null group by symbol", ["fw"], "up_given_label up_given_none")
def direction_asymmetry(spark, sf_dir):
    """Share of rises after a label."""
    x = v.forward_log_return(_sc(spark, sf_dir), ["account"], ["event_ts_ms", "id"], "ret", [5]).where("fwd_5 is not null")
    up = (F.col("fwd_5") > 0).cast("double")
    return x.groupBy("symbol").agg(F.avg(F.when(F.col("label") == 1, up)).alias("up_given_label"), F.avg(F.when(F.col("label") == 0, up)).alias("up_given_none"))


@query("label_balance", "select symbol, count(label) as n_valid, avg(label) as p_up, abs(avg(label) - 0.5) as skew from sc group by symbol", ["sc"], "p_up skew")
def label_balance(spark, sf_dir):
    """Rows, rate and skew of labels."""
    return _sc(spark, sf_dir).groupBy("symbol").agg(F.count("label").alias("n_valid"), F.avg("label").alias("p_up")).withColumn("skew", F.abs(F.col("p_up") - 0.5))


@query(
    "nonfinite_attribution",
    "select account, feature, n as bad, a as first_bad, b as last_bad, case when b - a + 1 = n and a = f then 'prefix' when b - a + 1 = n then 'clustered' else 'scattered' end as pattern from (select account, feature, count(*) filter (x) as n, min(pos) filter (x) as a, max(pos) filter (x) as b, min(pos) as f from (select account, row_number() over (partition by account order by event_ts_ms, id) as pos, unnest(['u', 'w']) as feature, unnest([score % 50 = 3, ret < -48]) as x from sc) group by all) where n > 0",
    ["sc"],
)
def nonfinite_attribution(spark, sf_dir):
    """Where features are not finite."""
    c = F.col
    x = _sc(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("account").orderBy("event_ts_ms", "id")))
    x = x.withColumn("u", F.when(c("score") % 50 == 3, float("nan")).otherwise(c("proba"))).withColumn("w", F.when(c("ret") < -48, None).otherwise(c("ret")))
    return v.nonfinite_attribution(x, ["account"], ["u", "w"], "pos")


view("oday", "select symbol, session, count(*) filter (d > 0) as up, count(*) filter (d < 0) as down, arg_min(vwap, ts_ms) as first_vwap, arg_max(vwap, ts_ms) as last_vwap, stddev_samp(r) as log_return_std, count(*) as n_events from (select *, lead(vwap, 500) over (partition by symbol, session order by ts_ms) - vwap as d, ln(vwap / lag(vwap) over (partition by symbol, session order by ts_ms)) as r from oev) group by all", ["oev"])


def _daily(spark, sf_dir):
    w = Window.partitionBy("symbol", "session").orderBy("ts_ms")
    x = o.order_events(o.dedup_counterparty(a.fills(spark, sf_dir)))
    x = x.withColumns({"d": F.lead("vwap", 500).over(w) - F.col("vwap"), "r": F.log(F.col("vwap") / F.lag("vwap").over(w))})
    return x.groupBy("symbol", "session").agg(
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.min_by("vwap", "ts_ms").alias("first_vwap"), F.max_by("vwap", "ts_ms").alias("last_vwap"), F.stddev_samp("r").alias("log_return_std"), F.count("*").alias("n_events"),
    )


@query("daily_direction_counts", "select * from oday", ["oday"], "first_vwap last_vwap log_return_std")
def daily_direction_counts(spark, sf_dir):
    """Ups, downs, first and last price and spread of returns by session."""
    return _daily(spark, sf_dir)


@query(
    "drift_implied_rate",
    "select *, least(greatest(0.5 + total_log_return / n_events * 500 / (2 * greatest(per_event_std * sqrt(500), 1e-10::double)), 0), 1) as implied_rate from (select symbol, ln(arg_max(last_vwap, session) / arg_min(first_vwap, session)) as total_log_return, sum(log_return_std * n_events) filter (log_return_std is not null) / sum(n_events) filter (log_return_std is not null) as per_event_std, sum(n_events)::bigint as n_events from oday group by symbol)",
    ["oday"],
    "total_log_return per_event_std implied_rate",
)
def drift_implied_rate(spark, sf_dir):
    """The rate that drift alone would give."""
    d, weight = _daily(spark, sf_dir), F.when(F.col("log_return_std").isNotNull(), F.col("n_events"))
    x = d.groupBy("symbol").agg(F.log(F.max_by("last_vwap", "session") / F.min_by("first_vwap", "session")).alias("total_log_return"), (F.sum(F.col("log_return_std") * weight) / F.sum(weight)).alias("per_event_std"), F.sum("n_events").alias("n_events"))
    implied = F.col("total_log_return") / F.col("n_events") * 500 / (F.greatest(F.col("per_event_std") * F.sqrt(F.lit(500.0)), F.lit(1e-10)) * 2) + 0.5
    return x.withColumn("implied_rate", o.clip(implied, 0, 1))


@query("label_rates", f"select symbol, {', '.join(f'avg({c}) as {c}' for c in ef.LABELS)}, count(distinct session) filter (wy_climax = 1) as climax_sessions from labelled group by symbol", ["labelled"], " ".join(ef.LABELS))
def label_rates(spark, sf_dir):
    """Firing rates of the event labels."""
    x = features(spark, sf_dir)
    return x.groupBy("symbol").agg(*[F.avg(c).alias(c) for c in ef.LABELS], F.count_distinct(F.when(F.col("wy_climax") == 1, F.col("session"))).alias("climax_sessions"))


@query(
    "synthetic_cascades",
    "select id, coalesce(abs(f) > case when count(f) over w >= 40 then quantile_cont(abs(f), 0.9) over w end, false)::int as label from (select *, lead(c, 3) over (partition by symbol, day order by event_ts_ms, id) - c as f from (select *, sum(ret) over (partition by symbol, day order by event_ts_ms, id) as c from sc)) window w as (partition by symbol, day order by event_ts_ms, id rows between 199 preceding and current row)",
    ["sc"],
)
def synthetic_cascades(spark, sf_dir):
    """Forward moves beyond their causal rolling quantile."""
    x = v.forward_log_return(_sc(spark, sf_dir), ["symbol", "day"], ["event_ts_ms", "id"], "ret", [3]).withColumn("m", F.abs("fwd_3")).withColumnRenamed("day", "session")
    x = o.rolling(x.select("symbol", "session", "id", "event_ts_ms", "m"), {"q": ("m", 0.9, 200, 40)}, ["event_ts_ms", "id"])
    return x.select("id", F.coalesce(F.col("m") > F.col("q"), F.lit(False)).cast("int").alias("label"))


@query("min_positive", "select symbol, count(*) as n from sc where symbol in (select symbol from sc group by symbol having sum(label) >= 500) group by symbol", ["sc"])
def min_positive(spark, sf_dir):
    """Symbols with enough positive labels."""
    return v.min_positive(_sc(spark, sf_dir), "symbol", "label", 500).groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    "confidence_cells",
    """select *, gross_round_trip_bps - cost_round_trip_bps as headroom_bps, coalesce(accuracy > 0.55 and lower_bound > 0.51 and gross_round_trip_bps - cost_round_trip_bps > 0, false) as tradeable from (
    select *, greatest(0, accuracy - 2 * sqrt(accuracy * (1 - accuracy) / n_windows)) as lower_bound, (2 * accuracy - 1) * mean_abs_edge_bps as gross_round_trip_bps, 2 * 4.0::double + 2 * mean_slip_bps as cost_round_trip_bps from (
    select symbol, score % 5 as quintile, count(*) as n_windows, avg(label) as accuracy, avg((2 * label - 1) * abs(e)) as mean_signed_return_bps, avg(abs(e)) as mean_abs_edge_bps, avg(case when e is not null then score / 10 end) as mean_slip_bps from (select *, case when score % 7 <> 0 then ret end as e from sc) group by all))""",
    ["sc"],
    "accuracy mean_signed_return_bps mean_abs_edge_bps mean_slip_bps lower_bound gross_round_trip_bps cost_round_trip_bps headroom_bps",
)
def confidence_cells(spark, sf_dir):
    """Accuracy, edge, cost and headroom by cell."""
    c = F.col
    x = _sc(spark, sf_dir).select("symbol", (c("score") % 5).alias("quintile"), c("label").alias("correct"), F.when(c("score") % 7 != 0, c("ret")).alias("edge_bps"), (c("score") / 10).alias("slip_avg_bps"))
    return v.confidence_cells(x, ["symbol", "quintile"])


view("feas", "select symbol, size, horizon, fillable, case when fillable then score / 10 * size end as slip_avg_bps, case horizon when 5 then f5 else f20 end as edge_bps from (select symbol, size, score, score >= 20 * size as fillable, lead(c, 5) over w - c as f5, lead(c, 20) over w - c as f20 from fw, (values (1), (3)) z(size) window w as (partition by account, size order by event_ts_ms, id)), (values (5), (20)) h(horizon)", ["fw"])
_ACC = [0.55, 0.6]
_ROOM = lambda a: f"case when fillable then (2 * {a}::double - 1) * abs(edge_bps) - (2 * 4.0::double + 2 * abs(slip_avg_bps)) end"
_RQ = lambda s, a: ", ".join([f"quantile_cont({_ROOM(a)}, {q}) as headroom{s}_{n}_bps" for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))] + [f"avg(({_ROOM(a)} > 0)::int::double) as frac_pos{s}"])
view(
    "cells",
    f"""select symbol, size, horizon, count(*) as n_windows, count({_ROOM(1.0)}) as n_fillable_with_edge, avg(fillable::int::double) as fillable_frac, quantile_cont(slip_avg_bps, 0.5) as slip_median_bps, quantile_cont(slip_avg_bps, 0.9) as slip_p90_bps, quantile_cont(edge_bps, 0.5) as edge_median_bps, quantile_cont(edge_bps, 0.75) as edge_p75_bps, quantile_cont(edge_bps, 0.9) as edge_p90_bps,
    {_RQ('', 1.0)}, {', '.join(_RQ(f'_{round(a * 1000)}', a) for a in _ACC)} from feas group by all""",
    ["feas"],
)
_CELLS = ["fillable_frac", "slip_median_bps", "slip_p90_bps", "edge_median_bps", "edge_p75_bps", "edge_p90_bps", *[f"headroom{s}_{n}_bps" for s in ("", "_550", "_600") for n in ("median", "p75", "p90")], "frac_pos", "frac_pos_550", "frac_pos_600"]


def _cells(spark, sf_dir):
    x = v.forward_log_return(_sc(spark, sf_dir), ["account"], ["event_ts_ms", "id"], "ret", [5, 20])
    x = x.withColumn("size", F.explode(F.array(F.lit(1), F.lit(3)))).withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(20))))
    c = F.col
    x = x.withColumn("fillable", c("score") >= c("size") * 20)
    x = x.withColumns({"slip_avg_bps": F.when(c("fillable"), c("score") / 10 * c("size")), "edge_bps": F.when(c("horizon") == 5, c("fwd_5")).otherwise(c("fwd_20"))})
    return v.feasibility_cells(x, ["symbol", "size", "horizon"], _ACC)


@query("feasibility_cells", "select * from cells", ["cells"], " ".join(_CELLS))
def feasibility_cells(spark, sf_dir):
    """Fill rates, costs, edges and headroom by symbol, size and horizon."""
    return _cells(spark, sf_dir)


@query("survivors", " union all ".join(f"select symbol, size, horizon, {a}::double as accuracy, headroom_{round(a * 1000)}_median_bps as headroom_median_bps, frac_pos_{round(a * 1000)} as frac_pos from cells where frac_pos_{round(a * 1000)} > 0.2 and headroom_{round(a * 1000)}_median_bps > -30" for a in _ACC), ["cells"], "headroom_median_bps frac_pos")
def survivors(spark, sf_dir):
    """Cells that pass thresholds at an accuracy."""
    return v.survivors(_cells(spark, sf_dir), ["symbol", "size", "horizon"], _ACC, 0.2, -30.0)


_X0 = "(id % 4294967296 * 2654435761 + r * 2246822519 + 5) % 4294967296"
_X1 = f"(xor({_X0}, {_X0} >> 16)::hugeint * 2246822507 % 4294967296)::bigint"
view("hashed", f"select id, score, label, proba, r, {_X1} as h from sc, range(1, 61) t(r)", ["sc"])
view("hashed2", "select * exclude (h), (xor(h, h >> 13)::hugeint * 3266489909 % 4294967296)::bigint as h from hashed", ["hashed"])
_STEPS = " + ".join(f"(u >= {c!r}::double)::int" for c in rb.STEPS.tolist())
view("poisson", f"select id, score, label, proba, r, {_STEPS} as w from (select *, (xor(h, h >> 16) + 0.5::double) / 4294967296 as u from hashed2)", ["hashed2"])
view(
    "row_replicates",
    """select r as replicate, positives, negatives, auc, (hits_0 / nullif(negatives, 0)::double + hits_1 / nullif(positives, 0)::double) / 2 as balanced_accuracy from (
    select r, sum(p)::bigint as positives, sum(n)::bigint as negatives, sum(p * (b + n / 2.0::double)) / nullif(sum(p) * sum(n), 0)::double as auc from (select *, coalesce(sum(n) over (partition by r order by s rows between unbounded preceding and 1 preceding), 0) as b from
    (select r, score / 100.0::double as s, sum(w * label) as p, sum(w * (1 - label)) as n from poisson group by all)) group by r)
    join (select r, sum(w) filter (label = 0 and score / 100.0::double <= 0.5) as hits_0, sum(w) filter (label = 1 and score / 100.0::double > 0.5) as hits_1 from poisson group by r) using (r)""",
    ["poisson"],
)


@query("row_bootstrap", "select * from row_replicates", ["row_replicates"], "auc balanced_accuracy")
def row_bootstrap(spark, sf_dir):
    """Replicates over rows, by Poisson weights."""
    x = _sc(spark, sf_dir).withColumn("score", F.col("score") / 100)
    return rb.replicate_auc(x, "id", "score", "label", 60, 5)


@query(
    "row_intervals",
    """select metric, low, high, mean, n, case when low > 0.55 then 'STRONG' when low > 0.5 then 'ABOVE_CHANCE' when high < 0.5 then 'BELOW_CHANCE' else 'INDISTINGUISHABLE' end as tier from (select metric, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high, avg(v) as mean, count(v) as n from (select unnest(['auc', 'balanced_accuracy']) as metric, unnest([auc, balanced_accuracy]) as v from row_replicates) group by metric)""",
    ["row_replicates"],
    "low high mean",
)
def row_intervals(spark, sf_dir):
    """Bounds of both metrics over rows, and what they say."""
    return rb.tiers(rb.interval(row_bootstrap(spark, sf_dir), ["auc", "balanced_accuracy"]))
