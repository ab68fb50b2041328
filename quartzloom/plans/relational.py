"""Queries for cleaning, filters, joins, aggregates and set operations on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzloom.functions import sequences as X
from quartzloom.functions import stats
from quartzloom.operators import aggregates as A
from quartzloom.operators import clean as C
from quartzloom.operators import filters, joins, sets, splits
from quartzloom.operators import structures as S
from quartzloom.plans.registry import query, table

#: Text forms of a number, in SQL that both engines take.
DIRTY = """case l_linenumber % 6 when 0 then concat('>', cast(l_extendedprice as string), ' ') when 1 then concat('<', cast(l_extendedprice as string), '.')
 when 2 then concat(substr(cast(l_extendedprice as string), 1, 1), ',', substr(cast(l_extendedprice as string), 2)) when 3 then 'n/a' when 4 then concat(cast(l_linenumber as string), 'd') else cast(l_extendedprice as string) end"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUM = "case when regexp_matches({0}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({0} as double) end"


def dirty(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(DIRTY).alias("raw"))


def _clean_sql(expression: str) -> str:
    return f"with t as (select l_orderkey, l_linenumber, {DIRTY} as raw from lineitem), u as (select *, {expression} as x from t) select l_orderkey, l_linenumber, {NUM.format('x')} as value from u"


@query(_clean_sql("replace(trim(raw, ' <>.'), ',', '')"))
def clean_strip_commas(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", C.strip_commas(F.col("raw")).alias("value"))


@query(_clean_sql("replace(replace(raw, '<', ''), '>', '')"))
def clean_any_angle(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", C.any_angle(F.col("raw")).alias("value"))


@query(_clean_sql("replace(replace(case when l_linenumber = 2 then null else raw end, '<', ''), '>', '')"))
def clean_coerce(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", C.coerce(F.when(F.col("l_linenumber") != 2, F.col("raw"))).alias("value"))


@query(f"select l_orderkey, l_linenumber, {NUM.format('raw')} as value from (select l_orderkey, l_linenumber, {DIRTY} as raw from lineitem)")
def lenient_cast(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", C.to_number(F.col("raw")).alias("value"))


def assays(spark, d):
    """Four measurements, some missing."""
    return table(spark, d, "lineitem").select(*KEYS, F.expr("nullif(l_discount, 0)").alias("ki"), F.expr("nullif(l_tax, 0)").alias("ic50"), F.expr("case when l_linenumber % 3 = 0 then l_quantity end").alias("kd"), F.expr("case when l_linenumber % 2 = 0 then l_extendedprice end").alias("ec50"))


ASSAYS = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_discount, 0) as ki, nullif(l_tax, 0) as ic50, case when l_linenumber % 3 = 0 then l_quantity end as kd, case when l_linenumber % 2 = 0 then l_extendedprice end as ec50 from lineitem)"


@query(f"select l_orderkey, l_linenumber, coalesce(ki, ic50, kd, ec50) as value from {ASSAYS} where coalesce(ki, ic50, kd, ec50) > 0")
def consolidate_first(spark, d):
    return assays(spark, d).select("l_orderkey", "l_linenumber", C.first_value("ki", "ic50", "kd", "ec50").alias("value")).filter("value > 0")


@query(f"select l_orderkey, l_linenumber, least(ki, ic50, kd) as value from {ASSAYS}")
def consolidate_min(spark, d):
    return assays(spark, d).select("l_orderkey", "l_linenumber", C.row_min("ki", "ic50", "kd").alias("value"))


@query(f"select l_orderkey, l_linenumber, list_median([ki, ic50, kd, ec50]) as value from {ASSAYS}".replace("list_median([ki, ic50, kd, ec50])", "list_aggregate([ki, ic50, kd, ec50], 'median')"))
def consolidate_median(spark, d):
    return assays(spark, d).select("l_orderkey", "l_linenumber", C.row_median(*map(F.col, ("ki", "ic50", "kd", "ec50"))).alias("value"))


@query("select c_custkey, coalesce(case when c_custkey % 3 = 0 then c_name end, case when c_custkey % 2 = 0 then c_mktsegment end) as id from customer")
def coalesce_ids(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr("case when c_custkey % 3 = 0 then c_name end").alias("a"), F.expr("case when c_custkey % 2 = 0 then c_mktsegment end").alias("b"))
    return df.select("c_custkey", C.coalesce_present(df, ["a", "absent", "b"]).alias("id"))


@query("select l_orderkey, l_linenumber, round(9 - log10(l_extendedprice), 6) as p from lineitem where l_extendedprice > 0")
def pvalue_scale(spark, d):
    return table(spark, d, "lineitem").filter("l_extendedprice > 0").select("l_orderkey", "l_linenumber", F.round(C.p_scale(F.col("l_extendedprice")), 6).alias("p"))


@query("select l_orderkey, l_linenumber, t.threshold, l_extendedprice >= t.threshold as is_active from lineitem join (select l_suppkey, median(l_extendedprice) as threshold from lineitem group by 1) t using (l_suppkey)")
def label_by_target_median(spark, d):
    return C.label_by_median(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "threshold", "is_active")


@query("select l_orderkey, l_linenumber, (l_extendedprice < t.q)::integer as active from lineitem join (select l_suppkey, quantile_cont(l_extendedprice, 0.25) as q from lineitem group by 1) t using (l_suppkey)")
def label_by_target_quantile(spark, d):
    return C.label_by_quantile(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 0.25).select("l_orderkey", "l_linenumber", "active")


def pairs(spark, d):
    rows = table(spark, d, "lineitem").select(*KEYS, "l_returnflag", "l_quantity")
    wild, mutant = filters.split_by(rows, F.col("l_returnflag") == "N")
    return joins.mutant_wild_pairs(mutant, wild, ["l_suppkey", "l_partkey"], "l_quantity").withColumn("fold", C.fold_change(F.col("wt_value"), F.col("l_quantity"))).withColumn("label", C.above(F.col("fold"), 2.0))


PAIRS = """w as (select l_suppkey, l_partkey, median(l_quantity) as wt_value from lineitem where l_returnflag = 'N' group by 1, 2),
p as (select l_orderkey, l_linenumber, l_returnflag, l_quantity, l_suppkey, l_partkey, wt_value, l_quantity / wt_value as fold, (l_quantity / wt_value > 2)::integer as label from lineitem join w using (l_suppkey, l_partkey) where l_returnflag <> 'N')"""


@query(f"with {PAIRS} select l_orderkey, l_linenumber, wt_value, l_quantity as mutant, round(fold, 6) as fold, label from p")
def fold_change_pairs(spark, d):
    return pairs(spark, d).select("l_orderkey", "l_linenumber", "wt_value", F.col("l_quantity").alias("mutant"), F.round("fold", 6).alias("fold"), "label")


@query("select m.l_orderkey, m.l_linenumber, w.l_orderkey as wt_orderkey, w.l_linenumber as wt_linenumber, w.l_quantity as wt_value from lineitem m join lineitem w on m.l_suppkey = w.l_suppkey and m.l_partkey = w.l_partkey where m.l_returnflag = 'R' and w.l_returnflag = 'N'")
def pairs_many_to_many(spark, d):
    rows = table(spark, d, "lineitem")
    wild = rows.filter("l_returnflag = 'N'").select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("wt_orderkey"), F.col("l_linenumber").alias("wt_linenumber"), F.col("l_quantity").alias("wt_value"))
    return rows.filter("l_returnflag = 'R'").join(wild, ["l_suppkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "wt_orderkey", "wt_linenumber", "wt_value")


@query(f"with {PAIRS}, v as (select l_suppkey, l_returnflag, label, count(*) as n from p group by 1, 2, 3), r as (select *, row_number() over (partition by l_suppkey, l_returnflag order by n desc, label) as k from v), a as (select l_suppkey, l_returnflag, median(wt_value) as wt, median(l_quantity) as mut, count(*) as n from p group by 1, 2) select l_suppkey, l_returnflag, r.label, wt, mut, a.n from a join r using (l_suppkey, l_returnflag) where k = 1")
def pair_vote_mode(spark, d):
    p, keys = pairs(spark, d), ["l_suppkey", "l_returnflag"]
    votes = p.groupBy(*keys).agg(A.mode("label").alias("label"), F.count("*").alias("n"))
    both = p.select(*keys, F.explode(F.create_map(F.lit("wt"), F.col("wt_value").cast("double"), F.lit("mut"), F.col("l_quantity").cast("double"))).alias("of", "v"))
    medians = A.quantiles(both, [*keys, "of"], "v", q=0.5).groupBy(*keys).agg(*(F.max(F.when(F.col("of") == c, F.col("q"))).alias(c) for c in ("wt", "mut")))
    return votes.join(medians, keys)


@query("select l_orderkey, l_linenumber, l_suppkey || '_' || l_returnflag as target_id, split_part(l_suppkey || '_' || l_returnflag, '_', 1) as target from lineitem")
def composite_key(spark, d):
    key = C.composite_key(F.col("l_suppkey"), F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key.alias("target_id"), C.key_head(key).alias("target"))


@query("select s_suppkey, r_regionkey as k2_cluster, n_nationkey as k3_cluster, null::integer as k4_cluster from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def path_columns(spark, d):
    n = table(spark, d, "nation")
    paths = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(";", "n_regionkey", "n_nationkey").alias("path"))
    return C.path_columns(paths, "path", range(2, 5))


@query("select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end, 0) as zeroed, round(coalesce(case when c_acctbal > 0 then c_acctbal end, avg(case when c_acctbal > 0 then c_acctbal end) over ()), 4) as filled from customer")
def fill_missing(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr("case when c_acctbal > 0 then c_acctbal end").alias("filled"))
    return C.fill_mean(df.withColumn("zeroed", F.coalesce("filled", F.lit(0.0))), ["filled"]).select("c_custkey", "zeroed", F.round("filled", 4).alias("filled"))


@query("select p_partkey, printf('%.1f', p_retailprice / 7) as one, printf('%.2f', p_size / 7.0::double) as two from part")
def format_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", C.decimals(F.col("p_retailprice") / 7, 1).alias("one"), C.decimals(F.col("p_size") / F.lit(7.0), 2).alias("two"))


@query("select p_partkey as p_part_id, p_brand as p_maker, 'x' as source from part")
def rename_select_constant(spark, d):
    df = table(spark, d, "part").drop("p_type").withColumnsRenamed({"p_partkey": "p part id", "p_brand": "p maker"}).withColumn("source", F.lit("x"))
    return C.rename_all(df, lambda c: c.replace(" ", "_")).select("p_part_id", "p_maker", "source")


@query("select 'p_partkey' as name union all select 'p_size' union all select 'p_retailprice'")
def select_numeric(spark, d):
    return spark.createDataFrame([(c,) for c in C.numeric_columns(table(spark, d, "part"))], "name string")


# filters


@query(f"select l_orderkey, l_linenumber, ki, ic50 from {ASSAYS} where ki is not null and ic50 is not null")
def drop_missing(spark, d):
    return assays(spark, d).select("l_orderkey", "l_linenumber", "ki", "ic50").dropna(subset=["ki", "ic50"])


@query(f"select l_orderkey, l_linenumber from {ASSAYS} where ki is not null and ic50 is not null and kd is not null and ec50 is not null")
def drop_any_missing(spark, d):
    return assays(spark, d).dropna().select("l_orderkey", "l_linenumber")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_keys(spark, d):
    keys = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.in_keys(table(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def anti_holdout(spark, d):
    held = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return filters.not_in_keys(table(spark, d, "supplier"), held, "s_nationkey").select("s_suppkey", "s_name")


@query("select case when l_discount > 0.05 then 'yes' else 'no' end as part, count(*)::bigint as n from lineitem group by 1")
def complement_parts(spark, d):
    a, b = filters.split_by(table(spark, d, "lineitem"), F.col("l_discount") > 0.05)
    return a.agg(F.count("*").alias("n")).select(F.lit("yes").alias("part"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("no"), "n"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice between 1000 and 50000")
def range_filter(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice between 1000 and 50000").select("o_orderkey", "o_totalprice")


@query("select doc_id, nullif(lang, 'en') as lang from documents where lang <> 'en' and source <> ''")
def non_empty_rows(spark, d):
    rows, _ = filters.non_empty(table(spark, d, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang"), "source"), "lang", "source")
    return rows.select("doc_id", "lang")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_totalprice is not null")
def sql_predicates(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ql_orders")
    return spark.sql("select o_orderkey, o_custkey from ql_orders where o_orderstatus = 'O' and o_totalprice is not null")


@query("select l_orderkey as assay_id, l_partkey as molregno, nullif(l_discount, 0) as standard_value from lineitem where l_returnflag = 'N' and l_discount <> 0")
def sql_scan_activities(spark, d):
    from quartzloom.sources.readers import sql_scan

    table(spark, d, "lineitem").selectExpr("l_orderkey as assay_id", "l_partkey as molregno", "if(l_returnflag = 'N', 'nM', 'uM') as standard_units", "nullif(l_discount, 0) as standard_value").createOrReplaceTempView("activities")
    return sql_scan(spark, "activities")


@query("select n_nationkey as tid, n_regionkey as related_tid from nation where n_regionkey <> 2")
def sql_scan_relations(spark, d):
    from quartzloom.sources.readers import sql_scan

    table(spark, d, "nation").selectExpr("n_nationkey as tid", "n_regionkey as related_tid", "if(n_regionkey = 2, 'SINGLE', 'SUBSET OF') as relationship").createOrReplaceTempView("target_relations")
    return sql_scan(spark, "relations")


@query("select count(*) filter (lang <> 'en' and source <> '')::bigint as kept, count(*) filter (lang = 'en' or source = '')::bigint as removed from documents")
def removed_rows(spark, d):
    rows, seen = filters.non_empty(table(spark, d, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang"), "source"), "lang", "source")
    return spark.createDataFrame([(rows.count(), seen.get["removed"])], "kept long, removed long")


def round_trip(spark, name, write, read):
    """What read(path) gives of what write(path) wrote to the shared folder; the folder is removed."""
    from uuid import uuid4

    from quartzloom.session import cut, shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/quartzloom-{name}-{uuid4().hex}"
    write(path)
    try:
        return cut(read(path))
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def csv_scan(spark, d):
    from quartzloom.sources import readers, sinks

    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return round_trip(spark, "csv", lambda p: sinks.write_csv(rows, p), lambda p: readers.read_csv(spark, p, "s_suppkey long, s_name string, s_acctbal double"))


@query("select p_partkey::varchar as key, p_name || ' \"quoted' as name from part")
def tsv_scan(spark, d):
    from quartzloom.sources import readers

    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size", F.concat("p_name", F.lit(' "quoted')).alias("name"))
    return round_trip(spark, "tsv", lambda p: rows.write.csv(p, sep="\t", header=True, quote="\0", escape="\0"), lambda p: readers.read_tsv(spark, p, ["key", "name"]))


@query("select s_suppkey::varchar as id, s_nationkey::varchar as key from supplier where s_suppkey % 10 <> 0")
def index_scan(spark, d):
    from quartzloom.sources import readers

    lines = F.expr("case s_suppkey % 10 when 0 then concat('# ', s_suppkey, ' x ', s_nationkey) when 1 then concat('  ', s_suppkey, '  x ', s_nationkey, ' more') else concat(s_suppkey, ' x ', s_nationkey) end")
    return round_trip(spark, "index", lambda p: table(spark, d, "supplier").select(lines.alias("value")).write.text(p), lambda p: readers.read_index(spark, p))


@query("select user_id::integer as run, (row_number() over (partition by user_id order by ts, event_id) - 1)::integer as epoch, round(value, 3) as loss from events")
def run_log_scan(spark, d):
    """The users' logs, several to a file, written with settings and header, and read again."""
    from quartzloom.sources import readers, sinks

    e = splits.ranked(table(spark, d, "events"), ["user_id"], "ts", "event_id", name="i").select(F.col("user_id").alias("run"), (F.col("i") - 1).cast("int").alias("epoch"), F.round("value", 3).alias("loss"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return round_trip(spark, "logs", lambda p: sinks.write_run_logs(e, p, "lr=0.1", parts=parts), lambda p: readers.read_run_logs(spark, p, "run int, epoch int, loss double").select("run", "epoch", "loss"))


@query("select n_name as target, n_nationkey as random_seed, 'model' as model_name, 300 as epochs from nation")
def task_list_scan(spark, d):
    from quartzloom.sources import readers, sinks

    rows = table(spark, d, "nation").select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("random_seed"))
    return round_trip(spark, "tasks", lambda p: sinks.write_csv(rows, p), lambda p: readers.read_tasks(spark, p, model_name="model", epochs=300))


@query("with c as (select *, count(*) over (partition by l_suppkey, l_partkey) as n from lineitem) select l_orderkey, l_linenumber from c where n >= 3")
def min_length_gate(spark, d):
    return filters.at_least(table(spark, d, "lineitem").withColumn("k", F.concat_ws("/", "l_suppkey", "l_partkey")), "k", 3).select("l_orderkey", "l_linenumber")


@query("select 'p_retailprice' as name union all select 'p_size'")
def varying_columns(spark, d):
    df = table(spark, d, "part").withColumn("flat", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in filters.varying(df, ["p_size", "p_retailprice", "flat"])], "name string")


@query("select status, count(*)::bigint as count from (select user_id, case when count(*) filter (value is not null) = 0 then 'failed_read' when count(*) < 60 then 'too_short' else 'success' end as status from events group by 1) group by 1")
def status_routing(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count("value") > 0).alias("ok"))
    return A.counters(runs.select(filters.log_status(F.col("n"), F.col("ok"), 60).alias("status")))


@query("select p_partkey, case when p_size % 2 = 0 and p_brand = 'Brand#11' then 'ENSG' || p_partkey end as id from part where p_size % 2 = 0 and p_brand = 'Brand#11'")
def record_predicates(spark, d):
    rec = F.struct(F.expr("concat(if(p_size % 2 = 0, 'ENSG', 'X'), p_partkey, '.7')").alias("id"), F.expr("if(p_brand = 'Brand#11', 'protein_coding', 'other')").alias("biotype"), F.lit("GRCh38").alias("assembly"))
    return table(spark, d, "part").select("p_partkey", F.explode(filters.coding_records(F.array(rec))).alias("id"))


@query("select case when freq > 0 then 'some' else 'none' end as part, count(*)::bigint as n from (select user_id, avg((event_type = 'purchase')::integer) as freq from events group by 1) group by 1")
def plot_partitions(spark, d):
    freq = table(spark, d, "events").groupBy("user_id").agg(A.share_true(F.col("event_type") == "purchase").alias("freq"))
    return freq.groupBy(F.when(F.col("freq") > 0, "some").otherwise("none").alias("part")).agg(F.count("*").alias("n"))


# joins


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000")
def inner_dimensions(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.lookup_all(o, (c, "c_custkey"), (table(spark, d, "nation"), "n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("select d.doc_id, d.source, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def left_lookup(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality")


@query("select l_orderkey, l_linenumber, s.n_name as supplier_nation, c.n_name as customer_nation from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey join nation c on c_nationkey = c.n_nationkey where s.n_regionkey = c.n_regionkey")
def chained_role_join(spark, d):
    n = table(spark, d, "nation")
    s = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("sr"))
    c = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"), F.col("n_regionkey").alias("cr"))
    suppliers = table(spark, d, "supplier").join(s, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "supplier_nation", "sr")
    customers = table(spark, d, "customer").join(c, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "customer_nation", "cr")
    o = table(spark, d, "orders").join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "customer_nation", "cr")
    return table(spark, d, "lineitem").join(suppliers, "l_suppkey").join(o, "l_orderkey").filter("sr = cr").select("l_orderkey", "l_linenumber", "supplier_nation", "customer_nation")


@query("select distinct l_suppkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def join_filter_distinct(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("l_suppkey", "o_custkey").distinct()


@query("select p_partkey, p_name, (select count(*) from lineitem where l_partkey = p_partkey)::bigint as n from part where p_size = 1")
def aggregate_before_join(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").filter("p_size = 1").join(n, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select c_custkey, n_name, n from customer join (select o_custkey as c_custkey, count(*)::bigint as n from orders group by 1) using (c_custkey) join nation on c_nationkey = n_nationkey")
def checked_lookup(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = joins.optional_join(joins.optional_join(table(spark, d, "customer"), None, "c_custkey"), orders, "c_custkey")
    return joins.checked_lookup(rows, n, "c_nationkey").select("c_custkey", "n_name", "n")


@query("select n_nationkey, seed, rate, dims from nation, (select unnest(range(5))::bigint as seed), (select unnest([0.0001, 0.00001])::double as rate), (select unnest([8, 16])::bigint as dims)")
def cross_grid(spark, d):
    g = joins.grid(spark, seed=list(range(5)), rate=[1e-4, 1e-5], dims=[8, 16])
    return table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(g))


@query("""with e as (select p_brand as brand, p_partkey * 1000 as s, p_partkey * 1000 + p_size as t, case when p_brand < 'Brand#3' then 1 else -1 end as strand from part),
w as (select *, sum(t - s + 1) over (partition by brand order by s * strand rows unbounded preceding) as hi from e),
o as (select distinct p_brand as brand, p_size * 7 as off from part)
select o.brand, off::integer as off, (case when strand > 0 then s + (off - (hi - (t - s + 1))) else t - (off - (hi - (t - s + 1))) end)::bigint as position from o join w on o.brand = w.brand and off >= hi - (t - s + 1) and off < hi""")
def exon_interval(spark, d):
    p = table(spark, d, "part")
    exons = p.select(F.col("p_brand").alias("brand"), (F.col("p_partkey") * 1000).alias("start"), (F.col("p_partkey") * 1000 + F.col("p_size")).alias("end"), F.when(F.col("p_brand") < "Brand#3", 1).otherwise(-1).alias("strand"))
    offsets = p.select(F.col("p_brand").alias("brand"), (F.col("p_size") * 7).alias("offset")).distinct()
    return joins.map_offsets(exons, offsets, "brand").select("brand", F.col("offset").alias("off"), "position")


@query("""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings)
select a.vec_id as l_id, b.vec_id as r_id, round((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), 9) as d2 from p a join p b on (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.01*0.01 where a.label < 5 and b.label >= 5""")
def spatial_range(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")))
    side = lambda s, df: df.select(F.col("vec_id").alias(f"{s}_id"), *(F.col(a).alias(f"{s}_{a}") for a in "xyz"))
    return joins.within(side("l", p.filter("label < 5")), side("r", p.filter("label >= 5")), 0.01).select("l_id", "r_id", F.round("distance2", 9).alias("d2"))


@query("with c as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_partkey order by l_quantity desc, l_orderkey * 10 + l_linenumber) as r from lineitem) select l_partkey, l_orderkey, l_linenumber, l_quantity from c where r = 1 and l_quantity / 50 >= 0.8")
def best_match_gate(spark, d):
    c = table(spark, d, "lineitem").withColumn("candidate", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return joins.best_match(c, "l_partkey", "l_quantity", F.col("l_quantity") / 50).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


# aggregates


@query("select p_brand, round(avg(p_size), 6) as p_size_mean, round(coalesce(stddev_samp(p_size), 0), 6) as p_size_std, round(avg(p_retailprice), 6) as p_retailprice_mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) as p_retailprice_std from part group by 1")
def family_mean_std(spark, d):
    out = A.mean_std(table(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"])
    return out.select("p_brand", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("select p_brand, round(avg(p_size), 6) as size from part group by 1 order by 1")
def group_mean_sorted(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("size")).orderBy("p_brand")


@query("select l_suppkey, median(l_extendedprice) as med, quantile_cont(l_extendedprice, 0.9) as q90 from lineitem group by 1")
def group_median_quantile(spark, d):
    return A.quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", med=0.5, q90=0.9)


@query("select n, count(*)::bigint as count from (select l_suppkey, count(distinct l_partkey)::bigint as n from lineitem group by 1) group by 1")
def family_distinct_histogram(spark, d):
    return A.distinct_histogram(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("select quality, count(*)::bigint as count, round(count(*) / sum(count(*)) over (), 9) as share from labels group by 1")
def class_distribution(spark, d):
    return A.value_shares(table(spark, d, "labels"), "quality").withColumn("share", F.round("share", 9))


@query("select l_suppkey, l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber, l_quantity) as r from lineitem) where r = 1")
def dedup_keep_first(spark, d):
    return A.first_by(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"], ["l_orderkey", "l_linenumber"])


@query("select l_suppkey, v from (select l_suppkey, l_discount as v, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_discount) as r from lineitem where l_discount <> 0) where r = 1")
def group_first_present(spark, d):
    df = table(spark, d, "lineitem").withColumn("v", F.expr("nullif(l_discount, 0)"))
    return df.groupBy("l_suppkey").agg(A.first_present("v", "l_orderkey", "l_linenumber").alias("v"))


@query("select user_id, round(avg((event_type = 'purchase')::integer), 9) as freq, round(avg(case when event_type = 'purchase' then value end), 6) as mean, count(*)::bigint as n from events group by 1")
def conditional_mean_frequency(spark, d):
    df = table(spark, d, "events").withColumn("delay", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-1.0))
    return df.groupBy("user_id").agg(F.round(A.share_true(F.col("event_type") == "purchase"), 9).alias("freq"), F.round(A.without_sentinel("delay"), 6).alias("mean"), F.count("*").alias("n"))


@query("select l_suppkey, list_sort(list(distinct l_returnflag)) as flags, string_agg(distinct l_linestatus, ',' order by l_linestatus) as statuses from lineitem group by 1".replace("list_sort(list(distinct l_returnflag)) as flags", "array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags"))
def collect_unique(spark, d):
    each = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(each("l_returnflag").alias("flags"), each("l_linestatus").alias("statuses"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r = 1")
def argmax_per_group(spark, d):
    return A.first_by(table(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"], ["event_id", "value"])


@query("(select 'max' as kind, l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 1) union all (select 'min', l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber limit 1)")
def argmax_global(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    top = df.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(1).select(F.lit("max").alias("kind"), "*")
    return top.union(df.orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(1).select(F.lit("min"), "*"))


@query("select 'l_tax' as feature, round(corr(l_extendedprice, l_tax), 6) as r from lineitem union all select 'l_quantity', round(corr(l_extendedprice, l_quantity), 6) from lineitem union all select 'l_discount', round(corr(l_extendedprice, nullif(l_discount, 0)), 6) from lineitem union all select 'flat', null")
def feature_correlation(spark, d):
    df = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_tax", F.expr("nullif(l_discount, 0)").alias("l_discount"), F.lit(1.0).alias("flat"))
    return A.correlations(df, "l_extendedprice", ["l_quantity", "l_tax", "l_discount", "flat"]).withColumn("r", F.round("r", 6))


@query("select p_brand, round(var_samp(p_retailprice), 4) as v from part group by 1")
def group_variance(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.var_samp("p_retailprice"), 4).alias("v"))


RESIDUES = sorted(S.VOLUMES) + ["HOH"]
_PROPERTIES = ", ".join(f"({i}, {S.VOLUMES.get(r, 0)}::double, {S.DONORS.get(r, 0)}, {S.ACCEPTORS.get(r, 0)}, {S.CHARGES.get(r, 0)}::double, {int(r not in S.HYDROPHOBIC and r != 'GLY')})" for i, r in enumerate(RESIDUES))


@query(f"""with r(i, v, d, a, c, p) as (values {_PROPERTIES}) select p_brand as structure, count(*)::bigint as num_residues, round(sum(v), 4) as volume, sum(d)::bigint as hbond_donors, sum(a)::bigint as hbond_acceptors, round(sum(c), 4) as net_charge, round(avg(p), 9) as polarity
from part join r on p_partkey % {len(RESIDUES)} = i group by 1""")
def property_sums(spark, d):
    residue = F.element_at(F.array(*map(F.lit, RESIDUES)), (F.col("p_partkey") % len(RESIDUES) + 1).cast("int"))
    out = S.describe(table(spark, d, "part").select(F.col("p_brand").alias("structure"), residue.alias("residue")))
    return out.select("structure", "num_residues", F.round("volume_A3", 4).alias("volume"), "hbond_donors", "hbond_acceptors", F.round("net_charge", 4).alias("net_charge"), F.round("polarity_score", 9).alias("polarity"))


@query("select l_returnflag, count(*)::bigint as n, round(avg(l_quantity), 5) as mean, round(var_pop(l_quantity), 3) as var from lineitem group by 1")
def mergeable_moments(spark, d):
    return _moments(table(spark, d, "lineitem").withColumn("x", F.col("l_quantity")))


@query("select l_returnflag, count(*)::bigint as n, round(avg(l_quantity + l_linenumber * 3), 5) as mean, round(var_pop(l_quantity + l_linenumber * 3), 3) as var from lineitem group by 1")
def moments_of_large_values(spark, d):
    """Values of a thousand million and more: the spread between batches must not cancel. The offset is taken off the mean at the end."""
    out = _moments(table(spark, d, "lineitem").withColumn("x", F.lit(1e9) + F.col("l_quantity") + F.col("l_linenumber") * 3), 1e9)
    return out


def _moments(df, offset: float = 0.0):
    parts = df.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"))
    out = A.merge_moments(parts, ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round(F.col("mean") - offset, 5).alias("mean"), F.round("var", 3).alias("var"))


@query("select label, dim::integer as dim, round(sum(x::double), 4) as total from (select label, unnest(embedding) as x, unnest(range(64)) as dim from embeddings) group by 1, 2")
def vector_sum(spark, d):
    return A.vector_sum(table(spark, d, "embeddings").withColumnRenamed("embedding", "vec"), ["label"], "vec").select("label", F.posexplode("vec").alias("dim", "total")).withColumn("total", F.round("total", 4))


@query("select dim::integer as dim, round(avg(x::double), 6) as mean, round(stddev_pop(x::double), 6) as std from (select unnest(embedding) as x, unnest(range(64)) as dim from embeddings) group by 1")
def vector_column_stats(spark, d):
    return A.column_stats(table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "v").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("with s as (select toxic as y, n_chars::double as s from labels join documents using (doc_id)), p as (select s from s where y = 1), q as (select s from s where y <> 1) select round((select sum(case when p.s > q.s then 1 when p.s = q.s then 0.5 else 0 end) from p, q) / ((select count(*) from p) * (select count(*) from q)), 9)::double as auc")
def exact_auc(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return A.auc(df.withColumn("s", F.col("n_chars").cast("double")), "toxic", "s").select(F.round("auc", 9).alias("auc"))


@query("select round(avg((quality = (n_chars > 300)::integer)::integer), 9) as accuracy from labels join documents using (doc_id)")
def accuracy(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("guess")), "doc_id")
    return df.agg(F.round(A.accuracy("quality", "guess"), 9).alias("accuracy"))


@query("select user_id, count(value)::bigint as n, round(avg(value), 6) as mean, round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 6) as t, (count(value) - 1)::bigint as df from events group by 1")
def t_statistic(spark, d):
    out = A.t_statistic(table(spark, d, "events"), ["user_id"], "value", 50.0)
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), "df")


@query()
def t_test(spark, d):
    return stats.one_tailed_test(table(spark, d, "events"), ["event_type"], "value", 50.0)


@query("select lang as split, count(*)::bigint as n_rows, count(distinct source)::bigint as n_groups, sum(quality)::bigint as n_positive, round(100 * avg(quality), 6) as pct_positive from labels join documents using (doc_id) group by 1")
def split_stats(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("split")), "doc_id")
    return A.split_stats(df, "split", "source", "quality").withColumn("pct_positive", F.round("pct_positive", 6))


@query("select event_type, greatest(max(value), 90.0)::double as limit_ from events group by 1".replace("limit_", '"limit"'))
def axis_limits(spark, d):
    return A.axis_limit(table(spark, d, "events"), ["event_type"], "value", 90.0)


@query("select l_linenumber as epoch, round(avg(l_quantity), 6) as loss from lineitem group by 1")
def epoch_average(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_quantity"), 6).alias("loss"))


@query("select l_suppkey, l_partkey from lineitem group by 1, 2")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


# set operations


@query("select c_custkey as id, c_name as name, c_acctbal as bal, null as seg from customer union all select s_suppkey, s_name, null, 'supplier' from supplier")
def union_mixed(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("seg"))
    return sets.union_mixed(a, b)


@query("select unnest(['lane', 'weight']) as name")
def missing_columns(spark, d):
    return spark.createDataFrame([(c,) for c in sorted(sets.missing_columns(table(spark, d, "lineitem"), ["l_orderkey", "weight", "l_tax", "lane"]))], "name string")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def distinct_union(spark, d):
    return sets.distinct_values("k", table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark, d):
    return sets.union_all(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select count(*) = 0 as disjoint from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')")
def disjointness(spark, d):
    o = table(spark, d, "orders")
    return spark.createDataFrame([(sets.are_disjoint(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey"),)], "disjoint boolean")


@query("select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier)")
def except_keys(spark, d):
    return sets.except_rows(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")))


# sequences and text


PROTEIN = "translate(upper(substr(text, 1, 60)), 'BJOUXZ .,', 'ACDEFGHIK')"


@query("select c_custkey, m as mutations from (select c_custkey, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[A-Z][0-9]+[A-Z]'))), ','), '') as m from (select c_custkey, 'A' || c_custkey || 'B x' || c_nationkey || 'K' || c_nationkey || 'T ' || c_mktsegment as t from customer))")
def mutation_parse(spark, d):
    t = F.expr("concat('A', c_custkey, 'B x', c_nationkey, 'K', c_nationkey, 'T ', c_mktsegment)")
    return table(spark, d, "customer").select("c_custkey", X.point_mutations(t).alias("mutations"))


@query("""with s as (select p_partkey, p_name as w, case p_partkey % 4 when 0 then p_name when 1 then 'Q' || substr(p_name, 2) when 2 then substr(p_name, 1, 3) || substr(p_name, 5) else p_name || 'x' end as m from part)
select p_partkey, case when length(w) = length(m) then nullif(array_to_string(list_sort(list_filter([case when w[i] <> m[i] then w[i] || i || m[i] end for i in range(1, length(w) + 1)], lambda x: x is not null)), ','), '')
 when length(w) = length(m) + 1 then (with i as (select min(k) as k from (select unnest(range(1, length(w) + 1)) as k) where w[k] is distinct from m[k]) select w[k] || k || 'del' from i) end as diff from s""".replace("(with i as (select min(k) as k from (select unnest(range(1, length(w) + 1)) as k) where w[k] is distinct from m[k]) select w[k] || k || 'del' from i)", "list_filter([case when w[i] is distinct from m[i] then w[i] || i || 'del' end for i in range(1, length(w) + 1)], lambda x: x is not null)[1]"))
def sequence_diff(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("w"), F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat('Q', substr(p_name, 2)) when 2 then concat(substr(p_name, 1, 3), substr(p_name, 5)) else concat(p_name, 'x') end").alias("m"))
    return s.select("p_partkey", X.sequence_diff(F.col("w"), F.col("m")).alias("diff"))


@query("""with s as (select p_partkey, upper(replace(p_name, ' ', '')) as s, p_partkey % 4 as kind, p_size from part),
k as (select *, (p_size % (length(s) + 1) + 1)::integer as k from s), l as (select *, substr(s, k, 1) as a, case when kind = 2 then 'M' || substr(s, 2) else s end as t from k)
select p_partkey, case when kind = 3 or k > length(s) then null when kind = 1 and a <> 'Z' then null when kind = 2 and substr(t, k, 1) <> a then null else substr(t, 1, k - 1) || 'W' || substr(t, k + 1) end as edited from l""")
def apply_edits(spark, d):
    """Edits at every place, also beyond the end, about another letter, malformed, and two in turn."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "upper(replace(p_name, ' ', '')) as s", "p_partkey % 4 as kind", "p_size")
    rows = rows.withColumn("k", F.expr("p_size % (length(s) + 1) + 1")).withColumn("at", F.expr("substr(s, k, 1)"))
    edits = F.expr("case kind when 0 then concat(at, k, 'W') when 1 then concat('Z', k, 'W') when 2 then concat(substr(s, 1, 1), '1M, ', at, k, 'W') else 'q' end")
    return rows.select("p_partkey", X.apply_edits(F.col("s"), edits).alias("edited"))


#: 6 to 25 bases for each part.
BASES = "translate(substr(md5(cast(p_partkey as {0})), 1, cast(6 + p_size % 20 as integer)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
#: An amino acid by the place of its codon in the standard code.
AMINO = f"substr('{X.GENETIC_CODE}', 16 * (strpos('TCAG', substr({{0}}, 1, 1)) - 1) + 4 * (strpos('TCAG', substr({{0}}, 2, 1)) - 1) + strpos('TCAG', substr({{0}}, 3, 1)), 1)"


@query(f"""with c as (select p_partkey, {BASES.format('varchar')} as c from part), t as (select p_partkey, list_transform(list_transform(range(1, length(c) + 1, 3), lambda i: substr(c, i, 3)), lambda x: case when length(x) < 3 then '?' else {AMINO.format('x')} end) as t from c),
p as (select p_partkey, array_to_string(t, '') as protein from t) select p_partkey, protein, trim(protein, '?') as stripped from p""")
def codon_translate(spark, d):
    out = X.translate_codons(F.expr(BASES.format("string")))
    return table(spark, d, "part").select("p_partkey", out.alias("protein"), X.strip_unknown(out).alias("stripped"))


@query("select p_partkey, case when p_partkey % 7 <> 0 then chr(65 + (p_partkey % 26)::integer) end as ref, case when p_partkey % 7 <> 0 then p_size end as pos, case when p_partkey % 7 <> 0 then chr(65 + (p_size % 26)::integer) end as alt from part")
def mutation_fields(spark, d):
    t = F.expr("concat(chr(65 + p_partkey % 26), p_size, chr(65 + p_size % 26))")
    p = X.parse_mutation(F.when(F.col("p_partkey") % 7 == 0, F.lower(t)).otherwise(t))
    return table(spark, d, "part").select("p_partkey", p["ref"].alias("ref"), p["pos"].alias("pos"), p["alt"].alias("alt"))


AMINOS = "substr('ACDEFGHIKLMNPQRSTVWYX', cast(p_size % 21 + 1 as integer), 1)"
FIRST = ", ".join(f"('{a}', '{c}')" for a, c in X.FIRST_CODON.items())


@query(f"""with f(a, n) as (values {FIRST}), c as (select p_partkey, substr({BASES.format('varchar')}, 1, 3) as c, {AMINOS} as a from part),
x as (select p_partkey, c, n, (c[1] <> n[1])::integer + (c[2] <> n[2])::integer + (c[3] <> n[3])::integer as off, case when c[1] <> n[1] then 0 when c[2] <> n[2] then 1 else 2 end as i from c left join f using (a))
select p_partkey, case when off = 1 then i when off > 1 then 0 end as at, case when off = 1 then c[i + 1] when off > 1 then c end as ref, case when off = 1 then n[i + 1] when off > 1 then n end as alt from x""")
def codon_change(spark, d):
    c = X.codon_change(F.substring(F.expr(BASES.format("string")), 1, 3), F.expr(AMINOS))
    return table(spark, d, "part").select("p_partkey", c["at"].alias("at"), c["ref"].alias("ref"), c["alt"].alias("alt"))


WINDOW_INPUT = ("p_partkey", "translate(md5(cast(p_partkey as {0})), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') as q", "cast(p_size % 32 as integer) as pos", "cast(p_partkey % 3 as integer) as off", "p_size")


@query(f"""with s as (select {', '.join(WINDOW_INPUT).format('varchar')} from part), t as (select *, case when p_size % 5 = 0 then reverse(q) else substr('WWYY', 1, (p_size % 5)::integer) || q end as t from s),
c as (select *, pos + off as moved, greatest(0, pos - 5) as lo, greatest(0, pos + off - 5) as tlo from t),
w as (select *, substr(q, lo + 1, least(length(q), pos + 6) - lo) as here, substr(t, tlo + 1, least(length(t), moved + 6) - tlo) as there from c)
select p_partkey, (case when here = there then moved when strpos(t, here) > 0 then strpos(t, here) - 1 + pos - lo end)::integer as place from w""")
def context_window(spark, d):
    """Targets with other letters before the query, by which places move, and reversed ones, where nothing is found."""
    rows = table(spark, d, "part").selectExpr(*(x.format("string") for x in WINDOW_INPUT))
    target = F.expr("case when p_size % 5 = 0 then reverse(q) else concat(substr('WWYY', 1, cast(p_size % 5 as integer)), q) end")
    return rows.select("p_partkey", X.locate_context(F.col("q"), target, F.col("pos"), F.col("off")).alias("place"))


@query("select page_id, lower(nullif(regexp_extract(url, '[A-Za-z0-9]{4}'), '')) as id from pages")
def normalise_id(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalise_id(F.col("url")).alias("id"))


@query("select page_id, unnest(string_split(url, '/')) as part from pages")
def explode_multi(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode_outer(F.split("url", "/")).alias("part"))


@query("""select event_id, trim(split_part(trim(props, '{}'), ':', 1)) as key, trim(substr(trim(props, '{}'), strpos(trim(props, '{}'), ':') + 1)) as text, try_cast(trim(substr(trim(props, '{}'), strpos(trim(props, '{}'), ':') + 1)) as double) as number from events where strpos(props, ':') > 0""")
def key_value_lines(spark, d):
    kv = X.key_value(F.btrim(F.col("props"), F.lit("{}")))
    return table(spark, d, "events").select("event_id", kv.alias("kv")).filter("kv is not null").select("event_id", "kv.key", "kv.text", "kv.number")


@query("""select doc_id, block::integer as block, score from (select doc_id, unnest(range(1, 3)) as block, [n_chars / 10.0, n_chars / 20.0] as s from documents), (select 1), lateral (select round(s[block], 3)::double as score)""")
def block_text(spark, d):
    from quartzloom.sources.readers import parse_blocks

    text = F.format_string("head\nPocket 1 :\n Score : %.3f\n Kind : a\nPocket 2 :\n Score : %.3f\n", F.col("n_chars") / 10, F.col("n_chars") / 20)
    return parse_blocks(table(spark, d, "documents").select("doc_id", text.alias("value")), keys=["Score"]).select("doc_id", "block", F.col("Score").alias("score"))


@query("select p_partkey, array_to_string(string_split(p_brand, ''), ' ') as spaced, substr(sha1(p_name), 1, 8) as id, p_brand || '-lr0.1-edim' || p_size || '-seed3' as run from part".replace("array_to_string(string_split(p_brand, ''), ' ')", "trim(regexp_replace(p_brand, '(.)', '\\1 ', 'g'))"))
def text_forms(spark, d):
    return table(spark, d, "part").select("p_partkey", X.spaced(F.col("p_brand")).alias("spaced"), X.campaign_id(F.col("p_name")).alias("id"), X.run_name(F.col("p_brand"), F.lit("0.1"), F.col("p_size"), F.lit(3)).alias("run"))


@query("select doc_id, regexp_replace('>h' || chr(10) || substr(source, 1, 3) || chr(10) || lang, '^[^\\n]*\\n|\\s', '', 'g') as sequence from documents")
def fasta_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fasta_sequence(F.concat(F.lit(">h\n"), F.substring("source", 1, 3), F.lit("\n"), F.col("lang"))).alias("sequence"))


@query("select l_suppkey, floor((min(l_partkey) + max(l_partkey)) / 2)::bigint - 262144 as lo, floor((min(l_partkey) + max(l_partkey)) / 2)::bigint + 262144 as hi from lineitem group by 1")
def midpoint_window(spark, d):
    from quartzloom.functions.vectors import centred_window

    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(centred_window(F.min("l_partkey"), F.max("l_partkey")).alias("w"))
    return g.select("l_suppkey", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"))


@query("select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) where r <= 25")
def topk_per_group(spark, d):
    return splits.head_per_group(table(spark, d, "lineitem"), ["l_suppkey"], 25, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("select p_partkey, round(p_retailprice, 2) as price from part order by p_retailprice desc, p_partkey limit 10")
def sorted_head(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", F.round("p_retailprice", 2).alias("price"))


@query("select l_orderkey, l_linenumber, dense_rank() over (order by l_suppkey) - 1 as index from lineitem".replace("as index", 'as "index"'))
def dense_index(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    keys = splits.number_rows(rows.select("l_suppkey").distinct(), "l_suppkey")
    return rows.join(keys, "l_suppkey").select("l_orderkey", "l_linenumber", "index")


@query("select p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type || '_' || p_name), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title from part")
def title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", X.title(F.concat_ws("_", "p_type", "p_name")).alias("title"))


@query("select l_suppkey, n_scaffolds from (select l_suppkey, count(distinct p_type)::bigint as n_scaffolds from lineitem join part on l_partkey = p_partkey group by 1)")
def scaffold_counts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").join(p, "l_partkey").groupBy("l_suppkey").agg(F.countDistinct("p_type").alias("n_scaffolds"))


