"""Trials, tasks, manifests, traces and token arrays derived from the given tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import h12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: a paired trial of arms p and r; orders without lines are episodes without commands."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("p"), F.bool_or(F.col("l_returnflag") == "A").alias("r"),
        F.bool_or(F.col("l_discount") > 0.095).alias("c"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("f"),
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"),
    )
    o = table(spark, sf_dir, "orders")
    hot = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    t = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 3).alias("config"), hot.alias("faulted"),
        F.when(hot, F.col("o_orderpriority")).alias("family"), F.coalesce("p", F.lit(False)).alias("success_p"), F.coalesce("r", F.lit(False)).alias("success_r"),
        F.coalesce("c", F.lit(False)).alias("collateral"), F.coalesce("f", F.lit(0.0)).alias("fraction"), F.coalesce("n", F.lit(0)).alias("n_calls"),
        F.coalesce("q", F.lit(0.0)).alias("tokens"), F.to_date("o_orderdate").alias("day"),
    )
    return t.withColumns({f"reward_{a}": reward("collateral", F.col("n_calls") == 0, f"success_{a}", "fraction") for a in "pr"})


def reward(collateral: str, error: F.Column, success: str, fraction: str) -> F.Column:
    """-1 for collateral damage, 0 for a failed harness, else half for success and half for the passed fraction."""
    return F.when(F.col(collateral), -1.0).when(error, 0.0).otherwise(0.5 * F.col(success).cast("double") + 0.5 * F.col(fraction))


TRIALS = """trials as (select *, case when collateral then -1.0 when n_calls = 0 then 0.0 else 0.5 * success_p::int + 0.5 * fraction end as reward_p,
  case when collateral then -1.0 when n_calls = 0 then 0.0 else 0.5 * success_r::int + 0.5 * fraction end as reward_r from (
  select o_orderkey as row_id, o_custkey as task_id, o_orderkey % 3 as config, o_orderpriority in ('1-URGENT', '2-HIGH') as faulted,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderpriority end as family, coalesce(bool_or(l_returnflag = 'R'), false) as success_p,
  coalesce(bool_or(l_returnflag = 'A'), false) as success_r, coalesce(bool_or(l_discount > 0.095), false) as collateral,
  coalesce(avg(case when l_linestatus = 'O' then 1.0 when l_linestatus is not null then 0.0 end), 0.0)::double as fraction, count(l_orderkey) as n_calls,
  coalesce(sum(l_quantity), 0.0) as tokens, cast(o_orderdate as date) as day
  from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderpriority, o_orderdate))"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """File snapshots before and after, and permits (entry, kind): parts are files, changed by a hash of their key."""
    p = table(spark, sf_dir, "part").withColumn("m", h12("mut", F.col("p_partkey")) % 20)
    path = F.concat(F.lit("/home/user/"), "p_brand", F.lit("/"), "p_partkey")
    before = p.select(path.alias("path"), F.lit("f").alias("ftype"), F.lit("644").alias("mode"), F.lit("0").alias("uid"), F.col("p_size").cast("long").alias("size"), F.sha2("p_name", 256).alias("sha256"), F.lit(None).cast("string").alias("link"), "m")
    after = before.where("m <> 0").select(
        F.when(F.col("m") == 5, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(F.col("m") == 4, "l").otherwise(F.col("ftype")).alias("ftype"),
        F.when(F.col("m") == 2, "777").otherwise(F.col("mode")).alias("mode"), F.when(F.col("m") == 3, "1000").otherwise(F.col("uid")).alias("uid"),
        F.when(F.col("m").isin(1, 4), F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("m").isin(1, 4), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("m") == 4, "/elsewhere").alias("link"),
    )
    brands = p.select("p_brand", (F.substring("p_brand", -1, 1).cast("int") % 3).alias("k")).distinct().where("k = 0")
    entries = brands.select(F.concat(F.lit("/home/user/"), "p_brand", F.lit("/")).alias("entry"), F.explode(F.array(F.lit("deleted"), F.lit("mode_changed"))).alias("kind"))
    exact = p.where("p_partkey % 7 = 0").select(path.alias("entry"), F.lit("content_changed").alias("kind"))
    return before.drop("m"), after, entries.union(exact)


MANIFESTS = """parts as (select *, ('0x' || substr(sha256('mut:' || p_partkey), 1, 12))::bigint % 20 as m from part),
before as (select '/home/user/' || p_brand || '/' || p_partkey as path, 'f' as ftype, '644' as mode, '0' as uid, p_size::bigint as size, sha256(p_name) as sha256, null::varchar as link, m from parts),
after as (select case when m = 5 then path || '.new' else path end as path, case when m = 4 then 'l' else ftype end as ftype, case when m = 2 then '777' else mode end as mode,
  case when m = 3 then '1000' else uid end as uid, case when m in (1, 4) then size + 1 else size end as size, case when m in (1, 4) then sha256(sha256) else sha256 end as sha256,
  case when m = 4 then '/elsewhere' end as link from before where m <> 0),
permits as (select '/home/user/' || p_brand || '/' as entry, unnest(['deleted', 'mode_changed']) as kind from (select distinct p_brand from parts where substr(p_brand, -1, 1)::int % 3 = 0)
  union all select '/home/user/' || p_brand || '/' || p_partkey, 'content_changed' from parts where p_partkey % 7 = 0)"""


#: Places of the made-up files of an image, by p_partkey % 6.
PLACES = ("/usr/lib/python3/dist-packages/m{}.py", "/usr/bin/t{}", "/home/user/d{}.txt", "/opt/d{}", "/usr/local/lib/python3/site-packages/h{}.pth", "/usr/lib/l{}.so.1")


def images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots of an image: gold, damaged, and what a repair left of the damage; parts stand in for files."""
    key, k = F.col("p_partkey"), F.col("p_partkey") % 6
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", k.alias("k"), (h12("img", key) % 12).alias("m"), (h12("fix", key) % 4).alias("r"))
    place = F.coalesce(*(F.when(k == i, F.concat(F.lit(x.split("{}")[0]), key, F.lit(x.split("{}")[1]))) for i, x in enumerate(PLACES)))
    p = p.withColumns({"path": place, "was": F.concat(F.lit("x = "), F.col("p_size"), F.lit("\n"))})
    m, r, folder = F.col("m"), F.col("r"), k == 3
    is_new = (m == 4) & ~folder
    bad = F.when(m == 1, F.concat(F.lit("y = "), F.col("p_size"), F.lit("\n"))).otherwise(F.col("was"))
    mode = F.when(m.isin(2, 7), "777").otherwise("644")

    def snapshot(df: DataFrame, path: Column, text: Column, mode: Column, mtime: Column) -> DataFrame:
        return df.select(path.alias("path"), F.when(folder, "d").otherwise("f").alias("ftype"), mode.alias("mode"), F.char_length(text).cast("long").alias("size"), mtime.alias("mtime"), F.lit(None).cast("string").alias("link"), F.sha2(text, 256).alias("sha256"), text.alias("text"))

    here, other, same = F.col("path"), F.when(is_new, F.concat("path", F.lit(".so.9"))).otherwise(F.col("path")), F.col("was")
    gold = snapshot(p, here, same, F.lit("644"), key)
    damaged = snapshot(p.where("m <> 0"), other, bad, mode, F.when(m.isin(1, 3), key + 1).otherwise(key))
    text = F.when(r == 0, same).when((r == 1) & (m == 1), F.concat("was", F.lit("# mended\n"))).otherwise(bad)
    left = p.where((m != 0) | (r == 0)).where(~is_new | (r > 1))
    repaired = snapshot(left, F.when(is_new, other).otherwise(here), text, F.when(r == 0, "644").otherwise(mode), key)
    hook = snapshot(p.where("m = 5 and p_partkey % 7 = 0"), F.concat(F.lit("/usr/local/lib/python3/site-packages/n"), key, F.lit(".pth")), same, F.lit("644"), key)
    preload = snapshot(p.where("p_partkey = 1"), F.lit("/etc/ld.so.preload"), same, F.lit("644"), key)
    return gold, damaged, repaired.union(hook).union(preload)


def _image(where: str, path: str, text: str, mode: str, mtime: str) -> str:
    return f"select {path} as path, case when k = 3 then 'd' else 'f' end as ftype, {mode} as mode, length({text}) as size, {mtime} as mtime, sha256({text}) as sha256, {text} as text from files where {where}"


_BAD, _OTHER, _NEW = "case when m = 1 then 'y = ' || p_size || chr(10) else was end", "case when m = 4 and k <> 3 then path || '.so.9' else path end", "(m = 4 and k <> 3)"
IMAGES = f"""files as (select p_partkey, p_size, p_partkey % 6 as k, ('0x' || substr(sha256('img:' || p_partkey), 1, 12))::bigint % 12 as m, ('0x' || substr(sha256('fix:' || p_partkey), 1, 12))::bigint % 4 as r,
  replace({list(PLACES)}[p_partkey % 6 + 1], '{{}}', p_partkey::varchar) as path, 'x = ' || p_size || chr(10) as was from part),
gold as ({_image("true", "path", "was", "'644'", "p_partkey")}), damaged as ({_image("m <> 0", _OTHER, _BAD, "case when m in (2, 7) then '777' else '644' end", "case when m in (1, 3) then p_partkey + 1 else p_partkey end")}),
repaired as ({_image(f"(m <> 0 or r = 0) and (not {_NEW} or r > 1)", _OTHER, f"case when r = 0 then was when r = 1 and m = 1 then was || '# mended' || chr(10) else {_BAD} end", "case when r > 0 and m in (2, 7) then '777' else '644' end", "p_partkey")}
  union all {_image("m = 5 and p_partkey % 7 = 0", "'/usr/local/lib/python3/site-packages/n' || p_partkey || '.pth'", "was", "'644'", "p_partkey")} union all {_image("p_partkey = 1", "'/etc/ld.so.preload'", "was", "'644'", "p_partkey")})"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trials with all that a full summary asks for; arm p. The made-up fields stand in for a harness's records."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_tax") > 0.06).alias("seen"), F.bool_or(F.col("l_quantity") == 1).alias("made"), F.count_if(F.col("l_quantity") > 49).alias("refused"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("end_reason"), (F.col("o_totalprice") / 1000).alias("seconds"))
    more = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey")
    t = trials(spark, sf_dir).withColumnRenamed("faulted", "assigned")
    t = t.join(more, t["row_id"] == more["o_orderkey"])
    return t.select(
        "row_id", "task_id", "config", "assigned", "family", "collateral", "n_calls", "tokens", "end_reason", "seconds", F.col("success_p").alias("success"), F.col("reward_p").alias("reward"),
        (F.col("assigned") & F.coalesce("seen", F.lit(False))).alias("observed"), F.coalesce("made", F.lit(False)).alias("fabricated"), F.coalesce("refused", F.lit(0)).alias("refused"),
        F.when(F.col("config") > 0, 3 * F.col("config") + 1).alias("max_commands"), ((F.col("n_calls") == 0) & (F.col("end_reason") == "P")).alias("error"), (F.col("n_calls") + F.col("config")).alias("turns"),
        (F.col("success_p") & ~F.col("collateral")).alias("safe"),
    )


EPISODES = """episodes as (select row_id, task_id, config, faulted as assigned, family, collateral, n_calls, tokens, o_orderstatus as end_reason, o_totalprice / 1000 as seconds, success_p as success,
  reward_p as reward, faulted and coalesce(seen, false) as observed, coalesce(made, false) as fabricated, coalesce(refused, 0) as refused, case when config > 0 then 3 * config + 1 end as max_commands,
  n_calls = 0 and o_orderstatus = 'P' as error, n_calls + config as turns, success_p and not collateral as safe
  from trials join orders on o_orderkey = row_id left join (select l_orderkey, bool_or(l_tax > 0.06) as seen, bool_or(l_quantity = 1) as made, count_if(l_quantity > 49) as refused from lineitem group by 1) on l_orderkey = row_id)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks, with their labels as a review where there is one."""
    d, label = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(label, "doc_id", "left").select(F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.col("text").alias("instruction"), "source", F.col("lang").alias("category"), "quality", "toxic", "doc_id")


TASKS = "tasks as (select 'task_' || d.doc_id as task_id, text as instruction, source, lang as category, quality, toxic, d.doc_id from documents d left join labels l on l.doc_id = d.doc_id)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: step counts each user's events, zero is the share without signal, informative the rest."""
    e = table(spark, sf_dir, "events")
    s = e.select("user_id", "event_id", "ts", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), F.coalesce("value", F.lit(0.0)).alias("value"))
    s = s.withColumn("zero", F.when(F.col("event_type") == "error", 1.0).otherwise(F.when(h12("z", F.col("event_id")) % 3 == 0, 1.0).otherwise(0.5)))
    clipped = F.when((F.col("user_id") % 10 == 0) & (F.col("event_type") != "view"), 0.125).otherwise(0.0)
    broken = F.when(F.col("event_id") % 997 == 0, F.lit(float("inf"))).when(F.col("event_id") % 997 == 1, F.lit(float("nan"))).otherwise(1.0)
    return s.withColumns({"clipped": clipped, "loss": F.col("value"), "grad_norm": broken, "hours": F.col("value") / 100})


STEPS = """steps as (select *, case when event_type = 'error' then 1.0 when ('0x' || substr(sha256('z:' || event_id), 1, 12))::bigint % 3 = 0 then 1.0 else 0.5 end as zero from (
  select user_id, event_id, ts, event_type, case when user_id % 10 = 0 and event_type <> 'view' then 0.125 else 0.0 end as clipped,
  case when event_id % 997 = 0 then 'infinity'::double when event_id % 997 = 1 then 'nan'::double else 1.0 end as grad_norm, coalesce(value, 0.0) / 100 as hours, row_number() over (partition by user_id order by ts, event_id) as step, coalesce(value, 0.0) as value from events))"""
