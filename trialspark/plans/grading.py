"""Queries over snapshots, verdicts and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import grading as G
from trialspark.operators import snapshots as M
from trialspark.plans.summaries import T
from trialspark.plans.views import IMAGES, MANIFESTS, TASKS, images, manifests, table, tasks, trials

Q: dict = {}
O: dict[str, str] = {}
W = f"with {MANIFESTS}"
CHANGES = """, j as (select b.path, b.ftype, a.ftype as aft, a.path is null as gone, b.mode <> a.mode as mode_c, b.uid <> a.uid as uid_c, b.sha256 is distinct from a.sha256 as sha_c, b.link is distinct from a.link as link_c from before b left join after a using (path)),
changes as (select path, case when gone then ['deleted'] else list_filter([case when ftype <> aft then 'type_changed' end, case when ftype = aft and ftype = 'f' and sha_c then 'content_changed' end,
  case when mode_c then 'mode_changed' end, case when uid_c then 'owner_changed' end, case when ftype = aft and ftype = 'l' and link_c then 'link_changed' end], lambda x: x is not null) end as kinds from j),
allowed as (select b.path, list(distinct kind) as allowed from before b join permits p on p.entry = b.path or (p.entry like '%/' and starts_with(b.path, p.entry)) group by b.path)"""


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def joined(c: str) -> F.Column:
    return F.array_join(F.array_sort(c), ",")


@query("m1_manifest_diff", W + CHANGES + " select path, array_to_string(list_sort(kinds), ',') as kinds from changes where len(kinds) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    before, after, _ = manifests(s, d)
    return M.changed_kinds(before, after).select("path", joined("kinds").alias("kinds"))


@query("m2_permitted_diff", W + CHANGES + " select path, unnest(list_filter(kinds, lambda k: not list_contains(coalesce(allowed, []), k))) as kind from changes left join allowed using (path)")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.diff(*manifests(s, d))


@query("m3_write_sets_equal", W + CHANGES + ", w as (select path, unnest(kinds) as kind from changes), v as (select * from w where kind <> 'owner_changed') select count(*) as written, (select count(*) from (from v except all from w)) as only_first, (select count(*) from (from w except all from v)) as only_second from w")
def _(s: SparkSession, d: str) -> DataFrame:
    before, after, _ = manifests(s, d)
    one = M.changed_kinds(before, after).select("path", F.explode("kinds").alias("kind"))
    two = M.changed_kinds(before, after.withColumn("uid", F.lit("0"))).select("path", F.explode("kinds").alias("kind"))
    from trialspark.operators.aggregates import side_by_side

    return side_by_side(one.agg(F.count("*").alias("written")), two.exceptAll(one).agg(F.count("*").alias("only_first")), one.exceptAll(two).agg(F.count("*").alias("only_second")))


FAULTS = ", f as (select path as target, path || '.spare' as spare, m from before where m in (0, 1, 2, 3)), spare as (select path || '.spare' as path, sha256 from before where m in (0, 3))"


def fault_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    before, after, _ = manifests(s, d)
    from trialspark.functions.columns import h12

    m = h12("mut", F.element_at(F.split("path", "/"), -1)) % 20
    marked = before.withColumn("m", m)
    faults = marked.where("m in (0, 1, 2, 3)").select(F.col("path").alias("run"), F.col("path").alias("target"), F.concat("path", F.lit(".spare")).alias("spare"))
    spare = marked.where("m in (0, 3)").select(F.concat("path", F.lit(".spare")).alias("path"), "sha256", "size")
    return faults, before, after.select("path", "sha256", "size").union(spare)


@query("m4_input_integrity", W + FAULTS + " select f.target as run, case when a.sha256 <> b.sha256 and s.sha256 = b.sha256 then 'input_fabricated' when a.sha256 <> b.sha256 then 'input_replaced' when a.sha256 is null and s.sha256 is null then 'input_lost' end as problem from f join before b on b.path = f.target left join after a on a.path = f.target left join spare s on s.path = f.spare")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.input_integrity(*fault_tables(s, d), final=True).select("run", "problem")


@query("m5_fault_cleared", W + FAULTS + " select f.target as run, coalesce(a.sha256 = b.sha256, false) as cleared from f join before b on b.path = f.target left join after a on a.path = f.target")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.input_integrity(*fault_tables(s, d), final=True).select("run", "cleared")


@query("m6_effective_permit", W + " select entry, string_agg(distinct kind, ',' order by kind) as kinds from (select entry, kind from permits union all select path, 'type_changed' from before where m = 4) group by entry")
def _(s: SparkSession, d: str) -> DataFrame:
    before, after, permits = manifests(s, d)
    fault = after.where("ftype = 'l'").select(F.col("path").alias("entry"), F.lit("type_changed").alias("kind"))
    return permits.union(fault).groupBy("entry").agg(joined(F.collect_set("kind")).alias("kinds"))


DAMAGE = """, c as (select coalesce(g.path, d.path) as path, g.path is not null as was, d.path is not null as now, coalesce(d.ftype, g.ftype) = 'd' as folder, g.sha256 as gold_hash, g.mode as gold_mode, d.sha256 as bad_hash, d.mode as bad_mode from gold g full join damaged d using (path)),
dmg as (select path, case when folder then case when was and now and gold_mode <> bad_mode then 'dir_mode' end when not was then case when path not like '%d1%' then 'added' end when not now then 'deleted' when gold_hash <> bad_hash or gold_mode <> bad_mode then 'changed' end as change, gold_hash, gold_mode
from c where change is not null)"""
CODE = "(regexp_matches(d.path, '[.](py|pth|so)$') or regexp_matches(d.path, '[.]so[.][^/]*$') or d.path like '%/bin/%' or d.path like '%/sbin/%' or starts_with(d.path, '/etc/ld.so'))"


@query("m7_damage_set", f"with {IMAGES}" + DAMAGE + " select * from dmg")
def damage(s: SparkSession, d: str) -> DataFrame:
    gold, damaged, _ = images(s, d)
    return M.damage_set(gold, damaged, damaged.where("path like '%d1%'").select("path"))


@query("m8_merged_usr", "with p as (select '/' || ['bin', 'lib', 'opt'][p_partkey % 3 + 1] || '/' || p_name as path from part) select path as original, path from p union all select path, '/usr' || path from p where regexp_matches(path, '^/(bin|sbin|lib|lib64)/')")
def _(s: SparkSession, d: str) -> DataFrame:
    top = F.get(F.array(F.lit("bin"), F.lit("lib"), F.lit("opt")), (F.col("p_partkey") % 3).cast("int"))
    p = table(s, d, "part").select(F.concat(F.lit("/"), top, F.lit("/"), "p_name").alias("original"))
    return p.select("original", F.explode(M.merged_usr(F.col("original"))).alias("path"))


@query("m9_residue", f"with {IMAGES}" + DAMAGE + f""", j as (select d.*, n.path is not null as there, n.sha256 as now_hash, n.mode as now_mode, d.path like '%.py' and n.text = g.text || '# mended' || chr(10) as alike from dmg d left join repaired n on n.path = d.path left join gold g on g.path = d.path
where change in ('changed', 'dir_mode') or {CODE}), f as (select path, case when change = 'added' then case when there then 'added_still_present' end when change = 'dir_mode' then case when now_mode is distinct from gold_mode then 'dir_mode' end when not there then 'missing'
when now_hash <> gold_hash then case when not alike then 'content' end when now_mode <> gold_mode then 'mode' end as problem from j)
select path, problem from f where problem is not null union all select d.path, 'new_hook' from repaired d where regexp_matches(d.path, '^/usr/(local/)?lib/.*-packages.*[.]pth$') and d.path not in (select path from gold) union all select '/etc/ld.so.preload', 'ld_preload'""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Syntax trees are the same where the twin knows that a comment was added."""
    gold, _, repaired = images(s, d)
    return M.residue(damage(s, d), gold, repaired)


@query("m10_grader_disagreement", T + ", k as (select task_id, count_if(success_p and not collateral) as both_pass, count_if(success_p and collateral) as only_first, count(*) as n from trials group by task_id) select both_pass, only_first, count(*) as tasks, count_if(both_pass > 0 and both_pass < n) as mixed from k group by all")
def _(s: SparkSession, d: str) -> DataFrame:
    p, c = F.col("success_p"), F.col("collateral")
    k = trials(s, d).groupBy("task_id").agg(F.count_if(p & ~c).alias("both_pass"), F.count_if(p & c).alias("only_first"), F.count("*").alias("n"))
    return k.groupBy("both_pass", "only_first").agg(F.count("*").alias("tasks"), F.count_if((F.col("both_pass") > 0) & (F.col("both_pass") < F.col("n"))).alias("mixed"))


@query("m11_phase_verdicts", """with r as (select l_orderkey as run_id, l_linenumber as nodeid, 'passed' as setup, case l_returnflag when 'R' then 'failed' else 'passed' end as call, case when l_tax > 0.07 then 'failed' end as teardown, l_linenumber = 6 as gone from lineitem),
v as (select run_id, count_if(not gone and call = 'passed' and coalesce(teardown, 'passed') <> 'failed') as ok, count(*) as total, count_if(gone) as missing from r group by run_id) select run_id, case when missing > 0 then 0 else ok end as passed, total, missing = 0 and ok = total as success, missing from v""")
def _(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("nodeid"), F.lit("passed").alias("setup"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed").alias("call"), F.when(F.col("l_tax") > 0.07, "failed").alias("teardown"))
    return G.phase_verdicts(r.select("run_id", "nodeid"), r.where("nodeid not like '6-%'"))


@query("m12_listed_ids", """with k as (select l_orderkey as run_id, count(*) as n_ids, count_if(l_returnflag <> 'R') as n_pass, count_if(l_linestatus = 'F') as f from lineitem group by 1)
select run_id, n_ids = n_pass or f = 0 as pass, case when n_ids = n_pass then 'ids' when f = 0 then 'summary' end as rule, n_ids, n_pass from k""")
def _(s: SparkSession, d: str) -> DataFrame:
    test = F.concat(F.lit("t.py::n"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), test.alias("test_id"), F.concat(F.when(F.col("l_returnflag") == "R", "FAILED ").otherwise("PASSED "), test).alias("line"), (F.col("l_linestatus") == "F").alias("f"))
    logs = rows.groupBy("run_id").agg(F.concat_ws("\n", F.collect_list("line"), F.concat(F.lit("== "), F.count("*"), F.lit(" passed, "), F.count_if("f"), F.lit(" failed =="))).alias("log"))
    return G.listed_ids(logs, rows.select("run_id", "test_id"))


@query("m13_rewards", T + "select row_id, reward_p, success_p and not collateral as safe_success from trials")
def _(s: SparkSession, d: str) -> DataFrame:
    return trials(s, d).select("row_id", "reward_p", (F.col("success_p") & ~F.col("collateral")).alias("safe_success"))


@query("m14_native_scores", "with x as (select event_id, case event_id % 5 when 0 then 'nan' when 1 then '' when 2 then '1.2' else (value / 1000)::varchar end as t from events), y as (select event_id, try_cast(t as double) as v from x) select event_id, case when v between 0 and 1 and not isnan(v) then v else 0.0 end as score, coalesce(not (v between 0 and 1 and not isnan(v)), true) as error from y")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.when(k == 0, "nan").when(k == 1, "").when(k == 2, "1.2").otherwise((F.col("value") / 1000).cast("string"))
    score, error = G.score_of(text)
    return table(s, d, "events").select("event_id", score.alias("score"), error.alias("error"))


SETS = ", d as (select '/home/user/' || p_brand as path from parts where substr(p_brand, -1, 1) = '4' group by 1), u as (select path, 'f' as ftype, '600' as mode, '0' as uid, 1::bigint as size, sha256, null::varchar as link from before where m in (6, 7))"


@query("m15_apply_changes", W + SETS + ", k as (select b.path, b.mode, b.size from before b where not exists (select 1 from d where b.path = d.path or starts_with(b.path, d.path || '/')) and b.path not in (select path from u)) select path, mode, size from k union all select path, mode, size from u")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import h12

    before, _, _ = manifests(s, d)
    gone = before.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().where("path like '%4'")
    new = before.where((h12("mut", F.element_at(F.split("path", "/"), -1)) % 20).isin(6, 7)).withColumns({"mode": F.lit("600"), "size": F.lit(1).cast("long")}).withColumn("kind", F.lit("C"))
    changes = new.unionByName(gone.withColumn("kind", F.lit("D")), allowMissingColumns=True)
    return M.apply_changes(before, changes).select("path", "mode", "size")


@query("m16_discrimination", "with m as (select o_custkey as task, o_orderkey % 3 as output, case o_orderkey % 4 when 0 then 'm1' when 1 then 'm2' when 2 then 'm3' else 'm4' end as mutant, case when o_orderstatus = 'F' then 'caught' when o_totalprice > 400000 then 'survived' else 'n/a' end as result from orders), p as (select task, output, bool_or(result = 'caught') as c, bool_or(result = 'survived') as v from m where mutant <> 'm4' group by all) select task, count(*) as outputs, bool_and(c and not v) as passes from p group by task")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    m = table(s, d, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 3).alias("output"), F.when(k == 0, "m1").when(k == 1, "m2").when(k == 2, "m3").otherwise("m4").alias("mutant"), F.when(F.col("o_orderstatus") == "F", "caught").when(F.col("o_totalprice") > 400000, "survived").otherwise("n/a").alias("result"))
    return G.discrimination(m)


@query("m17_text_mutants", r"""with x as (select doc_id, text, string_split(text, chr(10)) as l, regexp_extract(text, '[0-9]') as dg from documents),
y as (select doc_id, text, '' as m1, array_to_string(l[1:len(l)-1], chr(10)) as m2, case when dg = '' then text else regexp_replace(text, '[0-9]', translate(dg, '0123456789', '1234567890')) end as m3, l[1] || chr(10) || text as m4 from x),
z as (select doc_id, text, unnest(['m1', 'm2', 'm3', 'm4']) as mutant, unnest([m1, m2, m3, m4]) as mutated from y) select doc_id, mutant, sha256(case when mutated <> text then mutated else 'n/a' end) as digest from z""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("mutant"), F.coalesce(m, F.lit("n/a")).alias("mutated")) for n, m in G.mutants_of(F.col("text"))))
    return table(s, d, "documents").select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.mutant", F.sha2("x.mutated", 256).alias("digest"))


@query("m18_graded_outputs", W + CHANGES + ", t as (select string_agg('check /home/user/' || p_brand || '/' || p_partkey, ' ' order by p_partkey) as test from parts where p_partkey % 11 = 0), o as (select path from changes where list_contains(kinds, 'content_changed') union select path from after where path not in (select path from before)) select path from o where path in (select '/home/user/' || p_brand || '/' || p_partkey from parts where p_partkey % 11 = 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    before, after, _ = manifests(s, d)
    changed = M.changed_kinds(before, after).where(F.array_contains("kinds", "content_changed")).select("path")
    outputs = changed.union(after.select("path").join(before.select("path"), "path", "left_anti"))
    tests = before.where(F.element_at(F.split("path", "/"), -1).cast("long") % 11 == 0).select(F.concat(F.lit("check "), "path").alias("test"))
    named = tests.select(F.explode(F.regexp_extract_all("test", F.lit("/[^ ]+"), 0)).alias("path")).distinct()
    return outputs.join(named, "path", "left_semi")


@query("m19_validity", T + ", v as (select task_id, bool_and(not success_p or n_calls > 0) as writes, bool_or(n_calls = 0) as err, bool_and(success_p or success_r) as refs, bool_or(collateral) as touched, count(distinct config) = 3 as same, bool_and(faulted) as noop from trials group by task_id) select task_id, not noop and not err and refs and writes and same and not touched as valid, refs and writes and same as fault_usable from v")
def _(s: SparkSession, d: str) -> DataFrame:
    p, r = F.col("success_p"), F.col("success_r")
    v = trials(s, d).groupBy("task_id").agg(F.bool_and(~p | (F.col("n_calls") > 0)).alias("writes"), F.bool_or(F.col("n_calls") == 0).alias("err"), F.bool_and(p | r).alias("refs"), F.bool_or("collateral").alias("touched"), (F.count_distinct("config") == 3).alias("same"), F.bool_and("faulted").alias("noop"))
    c = {n: F.col(n) for n in v.columns}
    yes = F.lit(True)
    return v.select("task_id", G.valid(c["noop"], c["err"], c["refs"], c["writes"], c["same"], c["touched"], yes).alias("valid"), G.fault_usable(c["refs"], c["writes"], c["same"], yes, yes).alias("fault_usable"))


@query("m20_admission_reasons", f"with {TASKS} select task_id, case when quality is null then 'pending' when toxic = 1 or quality = 0 or length(instruction) < 200 then 'rejected' else 'admissible' end as status, array_to_string(list_filter([case when toxic = 1 then 'exposure' end, case when quality = 0 then 'defect' end, case when length(instruction) < 200 then 'short' end], lambda x: x is not null), ',') as reasons from tasks")
def _(s: SparkSession, d: str) -> DataFrame:
    status, why = G.admission({"exposure": F.col("toxic") == 1, "defect": F.col("quality") == 0, "short": F.char_length("instruction") < 200}, F.col("quality").isNull())
    return tasks(s, d).select("task_id", status.alias("status"), F.array_join(why, ",").alias("reasons"))


@query("m21_runtime_admission", T + "select task_id, bool_or(not success_p) and bool_and(success_p or success_r) as admitted from trials group by task_id")
def _(s: SparkSession, d: str) -> DataFrame:
    t = trials(s, d).groupBy("task_id").agg(F.bool_or(~F.col("success_p")).alias("noop_fails"), F.collect_list(F.col("success_p") | F.col("success_r")).alias("references"))
    return t.select("task_id", (F.col("noop_fails") & F.forall("references", lambda x: x)).alias("admitted"))


@query("a19_change_counts", W + ", k as (select case when b.path is null then 'A' when a.path is null then 'D' else 'C' end as kind from before b full join after a using (path) where b.path is null or a.path is null or b.sha256 <> a.sha256 or b.mode <> a.mode or b.uid <> a.uid) select count_if(kind = 'A') as added, count_if(kind = 'C') as changed, count_if(kind = 'D') as deleted from k")
def _(s: SparkSession, d: str) -> DataFrame:
    before, after, _ = manifests(s, d)
    b, a = (x.select("path", F.struct("sha256", "mode", "uid").alias(n)) for x, n in ((before, "was"), (after, "is")))
    j = b.join(a, "path", "full_outer")
    changed = F.col("was").isNotNull() & F.col("is").isNotNull() & (F.col("was") != F.col("is"))
    return j.agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(changed).alias("changed"), F.count_if(F.col("is").isNull()).alias("deleted"))
