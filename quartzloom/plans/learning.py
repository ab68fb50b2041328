"""Queries for ordered series, splits, vectors and models on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.functions import vectors as V
from quartzloom.operators import curves, joins, splits
from quartzloom.plans.registry import query, table

# ordered series: a user's events are a run, numbered by time; its values, scaled to 0..1, the metrics


def series(spark, d) -> DataFrame:
    """run, epoch (0, 100, ...), val with gaps, train."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    numbered = splits.ranked(e, ["run"], "ts", "event_id", name="i").withColumn("epoch", ((F.col("i") - 1) * 100).cast("int"))
    return numbered.select("run", "epoch", F.when(F.col("i") % 7 != 3, F.col("value") / 100).alias("val"), F.least(F.lit(1.0), F.col("i") / 40).alias("train"))


SERIES = """c as (select user_id as run, ((i - 1) * 100)::integer as epoch, case when i % 7 <> 3 then value / 100 end as val, least(1.0, i / 40.0)::double as train
 from (select *, row_number() over (partition by user_id order by ts, event_id) as i from events))"""
FILLED = SERIES + """, g as (select run, epoch, train, last_value(val ignore nulls) over (partition by run order by epoch rows unbounded preceding) as val from c), f as (select * from g where val is not null and train is not null)"""


@query(f"with {FILLED} select run, epoch, val, train from f")
def ffill_series(spark, d):
    return curves.forward_fill(series(spark, d), ["val", "train"]).select("run", "epoch", "val", "train")


@query(f"with {FILLED} select run, epoch, round(case when count(val) over w = 5 then avg(val) over w end, 6) as m from f window w as (partition by run order by epoch rows between 4 preceding and current row)")
def smooth_trailing(spark, d):
    return curves.forward_fill(series(spark, d), ["val", "train"]).select("run", "epoch", F.round(curves.trailing_mean("val", 5), 6).alias("m"))


@query(f"with {FILLED} select run, epoch, round(avg(val) over (partition by run order by epoch rows between 2 preceding and 1 following), 6) as even, round(avg(val) over (partition by run order by epoch rows between 2 preceding and 2 following), 6) as odd from f")
def smooth_centred(spark, d):
    f = curves.forward_fill(series(spark, d), ["val", "train"])
    return f.select("run", "epoch", F.round(curves.centred_mean("val", 4), 6).alias("even"), F.round(curves.centred_mean("val", 5), 6).alias("odd"))


@query(f"with {FILLED} select run, coalesce(min(case when val > 0.9 then epoch end), -1)::integer as first from f group by 1")
def first_generalisation(spark, d):
    return curves.initial_generalisation(curves.forward_fill(series(spark, d), ["val", "train"]), threshold=0.9)


DETECT = FILLED + """, a as (select run, epoch, train as tr, val as va, row_number() over (partition by run order by epoch) - 1 as i, count(*) over (partition by run) as n,
 avg(val) over (partition by run order by epoch rows between 2 preceding and 2 following) as sm, avg(train) over (partition by run order by epoch rows between 4 preceding and current row) as tt,
 count(train) over (partition by run order by epoch rows between 4 preceding and current row) as tc from f),
h as (select run, min(case when tc = 5 and tt > 0.5 and n >= 20 then i end) as fi, min(case when tc = 5 and tt > 0.5 and n >= 20 then epoch end) as mem from a group by run),
b as (select a.*, lead(sm, 5) over (partition by run order by epoch) as s5, sum(sm) over (partition by run order by epoch rows between 5 following and 14 following) / 10 as post from a),
r as (select h.run, coalesce(max(h.mem), -1)::integer as mem, coalesce(min(case when b.i > h.fi and b.i < b.n - 15 and b.sm < 0.5 and b.i - h.fi > 5 and b.s5 - b.sm > 0.05 and b.post > 0.5 then b.epoch end), -1)::integer as event from h join b on b.run = h.run group by h.run)"""


def detected(spark, d):
    return curves.detect(curves.forward_fill(series(spark, d), ["val", "train"]), overfit=0.5, plateau=0.5)


@query(f"with {DETECT} select run, mem, event, case when mem <> -1 and event <> -1 then event - mem else -1 end as delay, event <> -1 as detected from r")
def delayed_event(spark, d):
    return detected(spark, d)


@query(f"""with {DETECT}, e as (select run, run % 10 as target, event - mem as delay from r where event <> -1 and mem <> -1), q as (select run % 10 as target, avg((event <> -1)::integer) as freq from r group by 1),
lo as (select 'Longest Delay' as label, run, target from e order by delay desc, run limit 1), sh as (select 'Shortest Delay' as label, run, target from e order by delay, run limit 1),
tp as (select target from q order by freq desc, target limit 1),
hf as (select 'Highest Frequency' as label, run, target from e where target = (select target from tp) and target not in (select target from lo union select target from sh) order by run limit 1),
picked as (select * from lo union all select * from sh union all select * from hf),
md as (select 'Mid Delay (' || delay || ')' as label, run from (select *, row_number() over (partition by target order by delay desc, run) as k from e where target not in (select target from picked)) where k = 1 order by delay desc, run limit (select 4 - count(*) from picked))
select label, run::varchar as run from (select label, run from picked union all select label, run from md)""")
def representatives(spark, d):
    r = splits_cut(detected(spark, d))
    runs = r.filter("detected and mem <> -1").select(F.col("run").cast("string").alias("run"), (F.col("run") % 10).alias("target"), "delay", F.col("run").alias("n"))
    freq = r.groupBy((F.col("run") % 10).alias("target")).agg(F.avg(F.col("detected").cast("int")).alias("freq"))
    return curves.representatives(runs.withColumn("run", F.lpad("run", 12, "0")), freq).withColumn("run", F.col("run").cast("long").cast("string"))


def splits_cut(df):
    from quartzloom.session import cut

    return cut(df)


@query(f"with {SERIES}, s as (select run, case when count(*) < 60 then 'too_short' else 'success' end as status from c group by 1) select run, status from s")
def run_status(spark, d):
    return curves.analyse(series(spark, d).withColumn("val", F.coalesce("val", F.lit(0.0))), least=60, overfit=0.5, plateau=0.5).select("run", "status")


# splits


def measured(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, d, "lineitem").join(p, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", F.expr("concat(p_type, if(l_partkey % 5 = 0, '', cast(l_partkey % 40 as string)))").alias("s0"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_suppkey", F.expr("if(l_orderkey % 50 = 0, '', s0)").alias("scaffold"), (F.col("l_extendedprice") > 30000).alias("is_active"))


MEASURED = "m as (select l_orderkey, l_linenumber, l_suppkey, case when l_orderkey % 50 = 0 then '' else p_type || case when l_partkey % 5 = 0 then '' else (l_partkey % 40)::varchar end end as scaffold, l_extendedprice > 30000 as is_active from lineitem join part on l_partkey = p_partkey)"


@query(f"""with {MEASURED}, z as (select l_suppkey, scaffold, count(*) as k, min(l_orderkey * 100 + l_linenumber) as f from m group by 1, 2), n as (select l_suppkey, sum(k) as n from z group by 1),
b as (select z.*, n.n, coalesce(sum(k) over (partition by z.l_suppkey order by k, f rows between unbounded preceding and 1 preceding), 0) < greatest(floor(n.n * 0.2), 1) as test from z join n using (l_suppkey) where scaffold <> ''),
s as (select l_suppkey, count(*) filter (test) as nt, count(*) filter (not test) as nr from b group by 1)
select m.l_orderkey, m.l_linenumber, case when n.n < 3 or coalesce(nt, 0) = 0 or coalesce(nr, 0) = 0 then 'train' when b.test is null then 'dropped' when b.test then 'test' else 'train' end as side
from m join n using (l_suppkey) left join s using (l_suppkey) left join b on m.l_suppkey = b.l_suppkey and m.scaffold = b.scaffold""")
def scaffold_style_split(spark, d):
    return splits.scaffold_split(measured(spark, d), "l_suppkey", "scaffold", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "side")


DRAW = "md5('42/' || l_orderkey || '/' || l_linenumber)"
DRAW1 = DRAW.replace("42/", "43/")


@query(f"with {MEASURED}, r as (select *, row_number() over (partition by l_suppkey order by {DRAW}, l_orderkey, l_linenumber) as k from m) select l_orderkey, l_linenumber from r where k <= 100")
def sample_cap(spark, d):
    return splits.sample_cap(measured(spark, d), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 100).select("l_orderkey", "l_linenumber")


@query(f"""with {MEASURED}, a as (select *, row_number() over (partition by l_suppkey order by {DRAW}, l_orderkey, l_linenumber) as k, count(*) over (partition by l_suppkey) as n from m where is_active),
i as (select *, row_number() over (partition by l_suppkey order by {DRAW1}, l_orderkey, l_linenumber) as k from m where not is_active), c as (select l_suppkey, least(max(n), 20) as take from a group by 1)
select l_orderkey, l_linenumber, is_active from a where k <= 20 union all select l_orderkey, l_linenumber, is_active from i join c using (l_suppkey) where k <= take""")
def balanced_sample(spark, d):
    return splits.balanced_sample(measured(spark, d), "l_suppkey", "is_active", ["l_orderkey", "l_linenumber"], 20).select("l_orderkey", "l_linenumber", "is_active")


@query(f"""with {MEASURED}, a0 as (select *, (row_number() over (partition by l_suppkey, scaffold order by l_orderkey, l_linenumber) > 1)::integer as rest from m where is_active),
a as (select *, row_number() over (partition by l_suppkey order by rest, {DRAW}, l_orderkey, l_linenumber) as k, count(*) over (partition by l_suppkey) as n from a0),
i as (select *, row_number() over (partition by l_suppkey order by {DRAW1}, l_orderkey, l_linenumber) as k from m where not is_active), c as (select l_suppkey, least(max(n), 20) as take from a group by 1)
select l_orderkey, l_linenumber, is_active from a where k <= 20 union all select l_orderkey, l_linenumber, is_active from i join c using (l_suppkey) where k <= take""")
def scaffold_first_sample(spark, d):
    return splits.balanced_sample(measured(spark, d), "l_suppkey", "is_active", ["l_orderkey", "l_linenumber"], 20, scaffold="scaffold").select("l_orderkey", "l_linenumber", "is_active")


@query(f"with {MEASURED} select l_suppkey, floor(count(*) filter (is_active) * 0.5)::bigint as n_active, least(floor(count(*) filter (is_active) * 0.5), count(*) filter (not is_active))::bigint as n_inactive from m group by 1")
def fractional_sample_counts(spark, d):
    s = splits.balanced_sample(measured(spark, d), "l_suppkey", "is_active", ["l_orderkey", "l_linenumber"], 0.5)
    return s.groupBy("l_suppkey").agg(F.count_if("is_active").alias("n_active"), F.count_if(~F.col("is_active")).alias("n_inactive"))


@query("""with s as (select s_suppkey, n_regionkey as k2, n_nationkey as k3 from supplier join nation on s_nationkey = n_nationkey),
h2 as (select k2 from (select distinct k2 from s) order by md5('42/2/' || k2), k2 limit (select greatest(1, count(distinct k2) // 5) from s)),
p2 as (select * from s where k2 not in (select k2 from h2)),
h3 as (select k3 from (select distinct k3 from p2) order by md5('42/3/' || k3), k3 limit (select greatest(1, count(distinct k3) // 5) from p2)),
p3 as (select * from p2 where k3 not in (select k3 from h3))
select 'k2' as level, 'test' as side, s_suppkey from s where k2 in (select k2 from h2) union all select 'k2', 'train', s_suppkey from p2
union all select 'k3', 'test', s_suppkey from p2 where k3 in (select k3 from h3) union all select 'k3', 'train', s_suppkey from p3
union all select 'k4_from_k3', 'test', s_suppkey from p2 where k3 in (select k3 from h3) union all select 'k4_from_k3', 'train', s_suppkey from p3""")
def culling_split_levels(spark, d):
    n = table(spark, d, "nation")
    pool = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("k2_cluster"), F.col("n_nationkey").alias("k3_cluster"), F.lit(1).alias("k4_cluster"))
    out = None
    for level in splits.culling_split(pool, "s_suppkey", [2, 3, 4], {2, 3, 4}):
        for side in ("test", "train"):
            rows = getattr(level, side).select(F.lit(level.name).alias("level"), F.lit(side).alias("side"), "s_suppkey")
            out = rows if out is None else out.union(rows)
    return out


@query("select 'k2' as level, s_suppkey, split::integer as split from (select s_suppkey, n_regionkey as k2 from supplier join nation on s_nationkey = n_nationkey) s, (select unnest([1, 2, 3]) as split) p where k2 in (select k2 from (select distinct n_regionkey as k2 from supplier join nation on s_nationkey = n_nationkey) order by md5((41 + p.split)::varchar || '/2/' || k2), k2 limit 1)".replace("where k2 in (select k2 from (select distinct n_regionkey as k2 from supplier join nation on s_nationkey = n_nationkey) order by md5((41 + p.split)::varchar || '/2/' || k2), k2 limit 1)", "join (select split as sp, arg_min(k2, md5((41 + split)::varchar || '/2/' || k2)) as held from (select distinct n_regionkey as k2 from supplier join nation on s_nationkey = n_nationkey), (select unnest([1, 2, 3]) as split) group by 1) h on h.sp = p.split where s.k2 = h.held"))
def culling_split_repeated(spark, d):
    """The clusters held out at one level in three repetitions."""
    n = table(spark, d, "nation")
    pool = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("k2_cluster"))
    tests = [level.test.select(F.lit(level.name).alias("level"), "s_suppkey", F.lit(split).alias("split")) for split in (1, 2, 3) for level in splits.culling_split(pool, "s_suppkey", [2], {2}, split=split)]
    return tests[0].union(tests[1]).union(tests[2])


@query("select 5::bigint as n_folds, count(*)::bigint as n_rows, count(distinct source)::bigint as n_groups, sum(quality)::bigint as n_positive, 0::bigint as split_groups, true as even from labels join documents using (doc_id)")
def stratified_fold_invariants(spark, d):
    """Every group in one fold, every row in a fold, and class shares no further apart than the largest group's."""
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    folds = splits.stratified_group_folds(df, "source", "quality")
    rows = df.join(folds, "source")
    per = rows.groupBy("source").agg(F.countDistinct("fold").alias("k"), F.sum("quality").alias("p"), F.count("*").alias("n"))
    by = rows.groupBy("fold").agg(F.sum("quality").alias("p"), F.count("*").alias("n"))
    even = by.agg((F.max("p") - F.min("p")).alias("dp"), (F.max(F.col("n") - F.col("p")) - F.min(F.col("n") - F.col("p"))).alias("dq"), F.count("*").alias("n_folds"))
    one = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum("p").cast("long").alias("n_positive"), F.count_if(F.col("k") != 1).alias("split_groups"), F.max("p").alias("mp"), F.max(F.col("n") - F.col("p")).alias("mq"))
    return one.crossJoin(F.broadcast(even)).select("n_folds", "n_rows", "n_groups", "n_positive", "split_groups", ((F.col("dp") <= F.col("mp")) & (F.col("dq") <= F.col("mq"))).alias("even"))


@query()
def stratified_group_folds(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    folds = splits.stratified_group_folds(df, "source", "quality")
    return df.join(folds, "source").groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_groups"), F.sum("quality").cast("long").alias("n_positive"))


ROW = "'/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey"


@query(f"""with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_suppkey order by md5('42' || {ROW}), l_orderkey, l_linenumber, l_partkey) as k from lineitem),
b as (select l_suppkey, l_returnflag, row_number() over (partition by l_suppkey order by md5('43' || {ROW}), l_orderkey, l_linenumber, l_partkey) as k from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from a join b using (l_suppkey, k)""")
def label_permutation(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return splits.permute_labels(rows, "l_suppkey", "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("select doc_id from (select doc_id from documents order by md5('42/' || doc_id), doc_id limit 50)")
def random_subset(spark, d):
    return splits.subset(table(spark, d, "documents").select("doc_id"), 50, ["doc_id"])


@query("select n_nationkey, seed, rate, (((row_number() over (order by n_nationkey, seed, rate)) - 1) // 40 + 1)::bigint as chunk, n_name || '-lr' || rate || '-edim8-seed' || seed as run from nation, (select unnest(range(5))::bigint as seed), (select unnest(['0.1', '0.2']) as rate)")
def task_chunks(spark, d):
    from quartzloom.functions.sequences import run_name

    g = joins.grid(spark, seed=list(range(5)), rate=["0.1", "0.2"])
    tasks = table(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(g))
    return splits.chunks(tasks, 40, "n_nationkey", "seed", "rate").select("n_nationkey", "seed", "rate", "chunk", run_name(F.col("n_name"), F.col("rate"), F.lit(8), F.col("seed")).alias("run"))


@query("select d.doc_id, d.lang from documents d where source in (select source from documents join labels using (doc_id) where toxic = 1)")
def feature_prefilter(spark, d):
    docs = table(spark, d, "documents")
    keys = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("source").distinct()
    return docs.join(keys, "source", "left_semi").select("doc_id", "lang")


# vectors


def vecs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def unnested(df, name="x"):
    return df.select("vec_id", F.posexplode(name).alias("dim", "x")).withColumn("x", F.round("x", 6))


CELLS = "e as (select vec_id, label, unnest(embedding)::double as x, unnest(range(64))::integer as dim from embeddings)"


@query(f"with {CELLS}, s as (select dim, avg(x) as m, stddev_pop(x) as s from e group by 1) select vec_id, dim, round((x - m) / case when s = 0 then 1 else s end, 6) as x from e join s using (dim)")
def vector_standardise(spark, d):
    from quartzloom.models.cluster import standard_scale

    return unnested(standard_scale(vecs(spark, d), "v", "x"))


@query(f"with {CELLS}, s as (select dim, avg(x) as m, var_pop(x) as v from e group by 1) select vec_id, dim, round((x - m) / sqrt(v + 0.0000001), 6) as a, round((x - m) / (sqrt(v) + 0.0000001), 6) as b from e join s using (dim)")
def vector_standardise_eps(spark, d):
    s = vecs(spark, d).select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("s")).select(F.transform("s", lambda r: r["m"]).alias("m"), F.transform("s", lambda r: r["s"]).alias("s"))
    z = vecs(spark, d).join(F.broadcast(s)).select("vec_id", V.zscore_inside(F.col("v"), F.col("m"), F.col("s")).alias("a"), V.zscore_outside(F.col("v"), F.col("m"), F.col("s")).alias("b"))
    return z.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("dim", "r")).select("vec_id", "dim", F.round("r.a", 6).alias("a"), F.round("r.b", 6).alias("b"))


@query(f"with {CELLS}, n as (select vec_id, sqrt(sum(x * x)) as n, sum(x * x) as q from e group by 1) select vec_id, dim, round(x / (n + 0.00001), 6) as x, round(x / sqrt(greatest(q, 0.000000000001)), 6) as y from e join n using (vec_id)")
def vector_l2(spark, d):
    z = vecs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(V.l2(F.col("v")).alias("a"), V.l2_floor(F.col("v")).alias("b"))).alias("dim", "r"))
    return z.select("vec_id", "dim", F.round("r.a", 6).alias("x"), F.round("r.b", 6).alias("y"))


@query(f"with {CELLS} select a.vec_id, a.dim, round(a.x - b.x, 6) as x from e a join e b on b.vec_id = a.vec_id + 1 and a.dim = b.dim")
def vector_delta(spark, d):
    a = vecs(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return unnested(a.join(b, "vec_id").select("vec_id", V.delta(F.col("v"), F.col("w")).alias("x")))


@query(f"with {CELLS} select vec_id, round(sum(x), 6) as total, count(*)::bigint as n, round(sum(x) * sum(x) / sum(x * x), 6) as pr from e group by 1")
def vector_concat_participation(spark, d):
    v = F.col("v")
    halves = V.concat(F.slice(v, 1, 32), F.slice(v, 33, 32))
    return vecs(spark, d).select("vec_id", F.round(F.aggregate(halves, F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size(halves).cast("long").alias("n"), F.round(V.participation(V.nan_to_zero(halves)), 6).alias("pr"))


@query(f"with {CELLS} select vec_id, round(sum(x * (dim % 3 - 1)) + 0.5, 6) as score, case when round(sum(x * (dim % 3 - 1)) + 0.5, 6) >= 0 then 1 else -1 end as label from e group by 1")
def linear_scores(spark, d):
    out = V.linear_scores(vecs(spark, d), "v", [float(i % 3 - 1) for i in range(64)], 0.5)
    return out.select("vec_id", F.round("score", 6).alias("score")).withColumn("label", V.sign_label(F.col("score")))


def centroids(spark, d):
    """(id, vec): the mean vector of each label, which stand for a model's own points."""
    from quartzloom.operators.aggregates import vector_moments_by

    return vector_moments_by(vecs(spark, d), ["label"], "v").select(F.col("label").alias("id"), F.col("mean").alias("vec"))


CENTROIDS = CELLS + ", c as (select label as id, dim, avg(x) as x from e group by 1, 2)"


@query(f"with {CENTROIDS}, p as (select e.vec_id, c.id, sum((e.x - c.x) * (e.x - c.x)) as q from e join c using (dim) group by 1, 2) select vec_id, round(sum(case when id % 2 = 0 then 0.1 else -0.1 end * exp(-0.5 * q)) + 0.25, 6)::double as score from p group by 1")
def rbf_scores(spark, d):
    """Every vector scored with the mean vectors of the labels as support vectors."""
    sv = centroids(spark, d).select("vec", F.lit(0.1).alias("alpha"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("y"))
    return V.kernel_scores(vecs(spark, d), sv, "v", lambda a, b: V.rbf(a, b, 0.5), 0.25).select("vec_id", F.round("score", 6).alias("score"))


@query(f"with {CENTROIDS}, k as (select a.id as i, b.id as j, exp(-0.5 * sum((a.x - b.x) * (a.x - b.x)) filter (a.dim < 32)) as l, exp(-0.5 * sum((a.x - b.x) * (a.x - b.x)) filter (a.dim >= 32)) as p from c a join c b using (dim) group by 1, 2) select i, j, round(l * p, 6) as k from k")
def product_kernel(spark, d):
    """Gram tables of both halves of the labels' mean vectors, joined on ids: the pairs of a model's own points."""
    from quartzloom.models.kernels import gram

    c = centroids(spark, d)
    left = gram(c.select("id", F.slice("vec", 1, 32).alias("vec")), 0.5)
    right = gram(c.select("id", F.slice("vec", 33, 32).alias("vec")), 0.5)
    return left.join(right.withColumnRenamed("k", "p"), ["i", "j"]).select("i", "j", F.round(F.col("k") * F.col("p"), 6).alias("k"))


@query("select vec_id, round(1 / (1 + exp(-(embedding[1]::double) / sqrt(1 + pi() * (embedding[2]::double * embedding[2]::double) / 8))), 6) as p, case when label > 4 then 1 else -1 end as y from embeddings")
def squash_probability(spark, d):
    v = F.col("v")
    return vecs(spark, d).select("vec_id", F.round(V.squash(v[0], v[1] * v[1]), 6).alias("p"), V.to_signed(F.col("label") - 4).alias("y"))


@query(f"with {CELLS} select label, min_by(vec_id, d2) as vec_id from (select c.label, a.vec_id, round(sum((a.x - c.m) * (a.x - c.m)), 9) as d2 from e a join (select label, dim, avg(x) as m from e group by 1, 2) c using (dim) group by 1, 2) group by 1".replace("min_by(vec_id, d2) as vec_id from (", "arg_min(vec_id, d2) as vec_id from ("))
def nearest_centroid(spark, d):
    v = vecs(spark, d)
    cells = v.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    centres = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre")).withColumnRenamed("label", "centre_id")
    return joins.nearest(v, centres, "vec_id", "v").select(F.col("centre_id").alias("label"), "vec_id")


@query("select vec_id, round((embedding[1]::double + embedding[3]::double) / 2, 6) as masked, round((embedding[1]::double + embedding[2]::double + embedding[3]::double) / 3, 6) as plain from embeddings")
def mean_pooling(spark, d):
    v = F.col("v")
    tokens = F.array(*(F.slice(v, i, 1) for i in (1, 2, 3)))
    return vecs(spark, d).select("vec_id", F.round(V.mean_pool(tokens, F.array(F.lit(1), F.lit(0), F.lit(1)))[0], 6).alias("masked"), F.round(V.mean_pool(tokens)[0], 6).alias("plain"))


@query("select vec_id, round(embedding[1]::double, 6) as a, round(embedding[64]::double, 6) as z, 64::bigint as n from embeddings")
def flatten_tracks(spark, d):
    v = F.col("v")
    m = F.create_map(F.lit("b"), F.slice(v, 33, 32), F.lit("a"), F.slice(v, 1, 32))
    t = V.flatten_tracks(m)
    return vecs(spark, d).select("vec_id", F.round(t[0], 6).alias("a"), F.round(t[63], 6).alias("z"), F.size(t).cast("long").alias("n"))


@query(f"with {CELLS} select round(1 / (64 * var_pop(x)), 6) as scale, (1 / 64.0)::double as auto from e")
def kernel_gamma(spark, d):
    v = vecs(spark, d)
    return spark.createDataFrame([(V.gamma_of(v, "v", "scale"), V.gamma_of(v, "v", "auto"))], "scale double, auto double").withColumn("scale", F.round("scale", 6))


@query()
def alignment_scores(spark, d):
    """Part names against the name of the next part: score and offset of the best glocal alignment."""
    from quartzloom.functions.sequences import align_udf

    p = table(spark, d, "part").select("p_partkey", "p_name").repartition("p_partkey")  # a small file is one task's else
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", align_udf(F.col("p_name"), F.col("other")).alias("a")).select("p_partkey", "a.score", "a.offset")


CHANGES = "case when p_partkey % 11 = 0 then 'none' when p_partkey % 13 = 0 then 'A9W' when p_size % 5 = 3 then 'C1W' when p_size % 5 = 4 then 'A1A' else concat('A', p_size % 3 + 1, 'W') end"


@query(f"""with m as (select p_partkey, {CHANGES} as mutation, p_size % 3 as nth, p_partkey % 2 = 0 as forward from part),
r as (select *, case mutation when 'none' then 'not a point mutation' when 'A9W' then 'out of bounds' when 'C1W' then 'reference differs' when 'A1A' then 'synonymous or no codon' end as reason from m)
select p_partkey, mutation, reason, case when reason is null then case when forward then [100 + p_partkey, 100000000, 100000003][nth + 1] else [100000005, 100000002, 102 + p_partkey][nth + 1] end end::bigint as position,
 case when reason is null then 'GCT' end as reference_bases, case when reason is null then 'TGG' end as alternate_bases from r""")
def genomic_variants(spark, d):
    """A three-letter protein on two exons of either strand; each part changes one letter, or cannot, for every reason."""
    from quartzloom.plans.pipelines import genomic_variants as variants

    rows = table(spark, d, "part").selectExpr("p_partkey", f"{CHANGES} as mutation", "'AAA' as query", "'GCTGCTGCT' as cds", "0 as offset", "if(p_partkey % 2 = 0, 1, -1) as strand", "array(named_struct('start', 100000000L, 'end', 100000005L), named_struct('start', 100L + p_partkey, 'end', 102L + p_partkey)) as exons")
    return variants(rows).select("p_partkey", "mutation", "reason", "variant.*")


# models


def binary(spark, d):
    return vecs(spark, d).select("vec_id", "v", (F.col("label") < 5).cast("int").alias("y"))


@query()
def pca95(spark, d):
    from quartzloom.models.cluster import pca_share

    return pca_share(vecs(spark, d), "v", "reduced", 0.95).select("vec_id", F.size("reduced").alias("n_components"))


@query()
def kmeans_reps(spark, d):
    from quartzloom.models.cluster import representatives_of

    return representatives_of(vecs(spark, d), "vec_id", "v", k=10)


@query()
def ward_paths(spark, d):
    from quartzloom.models.cluster import hierarchy_paths

    return hierarchy_paths(vecs(spark, d), "vec_id", "v", 10)  # each vector is a target of its own


@query()
def svm_linear(spark, d):
    from quartzloom.models.train import sweep

    return sweep(binary(spark, d), "v", "y", "linear", joins.grid(spark, seed=[0, 1], C=[1.0]))


@query()
def svm_kernel(spark, d):
    from quartzloom.models.train import sweep

    return sweep(binary(spark, d), "v", "y", "kernel", joins.grid(spark, seed=[0, 1], C=[1.0]))


@query()
def svgp(spark, d):
    from quartzloom.models.train import sweep

    return sweep(binary(spark, d), "v", "y", "svgp", joins.grid(spark, seed=[0], lr=[0.05], epochs=[30]))


@query()
def sweep_curves(spark, d):
    from quartzloom.models.svgp import harmonic, participation
    from quartzloom.models.train import sweep_logs

    grid = joins.grid(spark, seed=[0, 1, 2, 3, 4], lr=[0.05, 0.01], encoder_dim=[8, 16])  # 20 runs
    return sweep_logs(binary(spark, d), "v", "y", grid, epochs=20, every=5, collective=participation, bias=harmonic(4.0, 0.1))


@query()
def svgp_predictions(spark, d):
    """Every vector by a model fitted on 500 of them at most."""
    from quartzloom.models import svgp as gp
    from quartzloom.models import svm, train

    rows = train.marked_rows(binary(spark, d), "v", "y", 42)

    def fit(pdf):
        x, y = train.arrays(pdf)
        z, mean, std = svm.scale(x)
        return gp.fit(z, y, gp.Settings(inducing=30, lr=0.05, epochs=10)), mean, std

    state, mean, std = train.in_worker(train.training_rows(rows, 500), fit)
    lit = lambda a: F.array(*(F.lit(float(v)) for v in a))
    scaled = V.l2(V.nan_to_zero(V.zscore(F.col("v"), lit(mean), lit(std))))
    return binary(spark, d).select("vec_id", "y", train.predictor(state)(scaled).alias("p")).select("vec_id", "y", "p.*")


def _pairs(spark, d, kind):
    """Vectors with the mean vectors of their own label (1) and of the next (-1)."""
    from quartzloom.models.train import pair_scores

    v, c = vecs(spark, d), centroids(spark, d)
    own = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("right_id"), F.lit(1).alias("y"))
    other = v.select(F.col("vec_id").alias("left_id"), ((F.col("label") + 1) % 10).alias("right_id"), F.lit(-1).alias("y"))
    return pair_scores(v.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), c, own.union(other), kind)


@query()
def svm_pairs_linear(spark, d):
    return _pairs(spark, d, "linear")


@query()
def svm_pairs_kernel(spark, d):
    return _pairs(spark, d, "kernel")
