"""Queries over trial summaries, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import comb
from trialspark.operators import aggregates as A
from trialspark.operators import inference as I
from trialspark.plans.views import EPISODES, TASKS, TRIALS, episodes, steps, table, tasks, trials
from trialspark.shared import materialise

Q: dict = {}
O: dict[str, str] = {}
T = f"with {TRIALS} "
E = f"with {TRIALS}, {EPISODES} "
REPLICATES = I.REPLICATES


def _mix(source: str, x: str, keep: str) -> str:
    """Three subqueries that mix the whole number x (below 2**32) of source."""
    for _ in range(2):
        source, x = f"(select {keep}, (xor({x}, {x} >> 16) * {I.MULTIPLIER}) & 4294967295 as x from {source})", "x"
    return f"(select {keep}, xor(x, x >> 16) as x from {source})"


def boot(seed: int, value: str, per: str = "per") -> str:
    """Subqueries c, draws, rep and v: all replicates' values of the clusters in per, sorted."""
    one = _mix(f"(select b, ((b + 1) * {I.STRIDE} + {seed * I.SEED_STRIDE}) & 4294967295 as x from range(0, {REPLICATES}) r(b))", "x", "b")
    two = _mix(f"(select b, x as one, (x + {I.OFFSET}) & 4294967295 as x from k1)", "x", "b, one")
    three = _mix("(select b, n, two, (one + j) & 4294967295 as x from k2, c)", "x", "b, n, two")
    four = _mix("(select b, n, xor(x, two) as x from k3)", "x", "b, n")
    return f""", c as (select *, row_number() over (order by task_id) - 1 as j, count(*) over () as n from {per}), k1 as {one}, k2 as (select b, one, x as two from {two}), k3 as {three},
draws as (select b, (x * n) >> 32 as drawn from {four}), rep as (select b, {value} as value from draws join c on c.j = drawn group by b), v as (select list_sort(list(value)) as v from rep)"""


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("a1_macro_mean", T + "select avg(p) as success_p, avg(r) as success_r from (select avg(success_p::int) as p, avg(success_r::int) as r from trials group by task_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.macro_mean(trials(s, d), "task_id", success_p=F.col("success_p"), success_r=F.col("success_r"))


@query("a2_rates", T + "select avg(collateral::int) filter (not faulted) as clean_collateral, avg(collateral::int) filter (n_calls > 1000) as none_null, coalesce(avg(collateral::int) filter (n_calls > 1000), 0.0) as none_zero from trials")
def _(s: SparkSession, d: str) -> DataFrame:
    c, none = F.col("collateral"), F.col("n_calls") > 1000
    return trials(s, d).agg(A.rate(c, ~F.col("faulted")).alias("clean_collateral"), A.rate(c, none).alias("none_null"), A.rate(c, none, 0.0).alias("none_zero"))


@query("a3_trial_summary", E + """, per as (select task_id, avg(safe::int) as safe, avg(safe::int) filter (assigned) as faulted, avg(safe::int) filter (not assigned) as clean, avg(success::int) as success, avg((not success)::int) as failure from episodes group by task_id),
g as (select count(distinct round_even(coalesce(reward, 0.0), 6)) > 1 as varies, count_if(safe) between 1 and count(*) - 1 as mixed from episodes group by task_id, config having count(*) > 1)
select count(*) as episodes, count(distinct task_id) as tasks, count_if(assigned) as faulted_episodes, count_if(not assigned) as clean_episodes, count_if(observed) as observed_faulted_episodes, (select avg(safe) from per) as safe_success_macro,
(select avg(faulted) from per) as safe_success_faulted, (select avg(clean) from per) as safe_success_clean, (select avg(success) from per) as success_macro, avg(collateral::int) filter (not assigned) as collateral_clean, avg(collateral::int) as collateral_all,
avg(fabricated::int) filter (assigned) as fabricated_input, avg((not success)::int) filter (observed) as recovery_failure_observed, avg((not safe)::int) filter (assigned) as failure_assigned_fault, avg((not success)::int) filter (assigned) as task_failure_assigned_fault,
(select avg(failure) from per) as task_failure_macro, (select string_agg(coalesce(m::varchar, 'none'), ',' order by m nulls first) from (select distinct max_commands as m from episodes)) as max_commands,
avg((coalesce(max_commands, 0) > 0 and n_calls >= max_commands and not success)::int) as unfinished_at_limit, avg(n_calls) as commands_mean, sum(refused)::bigint as refused_calls, avg(observed::int) filter (assigned) as fault_observed_rate,
(select string_agg(f || ':' || s || '/' || n, ',' order by f) from (select coalesce(family, 'clean') as f, count_if(safe) as s, count(*) as n from episodes group by 1)) as safe_success_by_family, (select count(*) from g) as groups_with_repeats,
(select count_if(varies) from g) as groups_reward_varies, (select count_if(mixed) from g) as groups_mixed_safe_success, count_if(n_calls = 0) as no_command_episodes, count_if(error) as harness_errors,
(select string_agg(r || ':' || n, ',' order by r) from (select end_reason as r, count(*) as n from episodes group by 1)) as end_reasons, avg(coalesce(reward, 0.0)) as reward_mean, avg(tokens) as gen_tokens_mean, avg(turns) as turns_mean, avg(seconds) as seconds_mean from episodes""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = A.trial_summary(episodes(s, d))
    text = lambda array, f: F.array_join(F.transform(array, f), ",").alias(array)
    shown = {
        "max_commands": text("max_commands", lambda k: F.coalesce(k.cast("string"), F.lit("none"))),
        "safe_success_by_family": text("safe_success_by_family", lambda r: F.concat(r["key"], F.lit(":"), r["safe"], F.lit("/"), r["episodes"])),
        "end_reasons": text("end_reasons", lambda r: F.concat(r["key"], F.lit(":"), r["episodes"])),
    }
    return x.select(*(shown.get(k, F.col(k)) for k in x.columns))


@query("a4_conditional_incidence", T + "select count(*) as trials, count_if(faulted) as observed, avg(faulted::int) as observation_rate, count_if(faulted and not success_p) as failures, avg((not success_p)::int) filter (faulted) as failure_given_observed from trials")
def _(s: SparkSession, d: str) -> DataFrame:
    seen, fail = F.col("faulted"), ~F.col("success_p")
    return trials(s, d).agg(F.count("*").alias("trials"), F.count_if(seen).alias("observed"), A.rate(seen).alias("observation_rate"), F.count_if(seen & fail).alias("failures"), A.rate(fail, seen).alias("failure_given_observed"))


@query("a5_pass_4", T + "select avg(greatest(c,0)*greatest(c-1,0)*greatest(c-2,0)*greatest(c-3,0)/(n*(n-1)*(n-2)*(n-3))::double) as pass_k, count(*) as tasks from (select count(*) as n, count_if(success_p) as c from trials group by task_id having count(*) >= 4)")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.pass_k(trials(s, d), "task_id", F.col("success_p"), 4)


@query("a6_a8_group_variation", T + """, g as (select count(*) as size, count(distinct round_even(coalesce(reward_p, 0), 6)) > 1 as varying, count_if(success_p) > 0 and count_if(success_p) < count(*) as mixed,
count(distinct collateral) > 1 as cv, arg_min(faulted, row_id) as ff from trials group by task_id, config)
select count(*) as groups, count_if(varying) as varying, count_if(mixed) as mixed, count_if(cv) as collateral_varying, count_if(cv and ff) as varying_faulted, coalesce(avg(varying::int), 0.0) as varying_rate from g""")
def _(s: SparkSession, d: str) -> DataFrame:
    g = A.group_variation(trials(s, d), ["task_id", "config"], "reward_p", "success_p", "collateral", "faulted", "row_id")
    return g.agg(F.count("*").alias("groups"), F.count_if("varying").alias("varying"), F.count_if("mixed").alias("mixed"), F.count_if("collateral_varies").alias("collateral_varying"), F.count_if(F.col("collateral_varies") & F.col("first_faulted")).alias("varying_faulted"), A.rate(F.col("varying"), empty=0.0).alias("varying_rate"))


@query("a9_histograms", "select event_type, user_id % 5 as bin, count(*) as n from events group by all")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.histogram(table(s, d, "events").select("event_type", (F.col("user_id") % 5).alias("bin")), "event_type", "bin")


@query("a10_distinct_hashes", "select count(distinct sha256(text)) as exact, count(distinct sha256(lower(text))) as normal, count(*) as n from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").agg(F.count_distinct(F.sha2("text", 256)).alias("exact"), F.count_distinct(F.sha2(F.lower("text"), 256)).alias("normal"), F.count("*").alias("n"))


@query("a11_success_rates", T + ", m as (select task_id, config, count(*) as n, count_if(success_p) as s from trials group by task_id, config), r as (select *, s / n::double as p from m) select task_id, config, n, s, p as rate, case when p <= 0.25 then 'hard' when p < 0.75 then 'medium' else 'easy' end as difficulty from r")
def _(s: SparkSession, d: str) -> DataFrame:
    m = trials(s, d).groupBy("task_id", "config").agg(F.count("*").alias("n"), F.count_if("success_p").alias("s"))
    p = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return m.withColumn("rate", p).withColumn("difficulty", F.when(F.col("rate") <= 0.25, "hard").when(F.col("rate") < 0.75, "medium").otherwise("easy"))


@query("a12_expected_in_band", T + "select sum(1 - (1-p)**8 - 8*p**7*(1-p) - p**8) as expected, count(*) as tasks from (select avg(success_p::int) as p from trials group by task_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    per = trials(s, d).groupBy("task_id").agg(F.avg(F.col("success_p").cast("double")).alias("p"))
    return per.agg(F.sum(A.band_expectation(F.col("p"))).alias("expected"), F.count("*").alias("tasks"))


@query("a13_admission_rollup", f"with {TASKS}" + """ select source, count(*) as n, count_if(quality = 1 and toxic = 0) as admissible, count_if(toxic = 1) as exposure, count_if(quality is null) as unverified,
count_if(quality = 1 and toxic = 0) / count(*)::double as of_all, count_if(quality = 1 and toxic = 0) / nullif(count_if(quality is not null), 0)::double as of_verifiable from tasks group by source""")
def _(s: SparkSession, d: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    known = F.count_if(F.col("quality").isNotNull())
    return tasks(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(good).alias("admissible"), F.count_if(F.col("toxic") == 1).alias("exposure"), F.count_if(F.col("quality").isNull()).alias("unverified"), (F.count_if(good) / F.count("*")).alias("of_all"), (F.count_if(good) / F.when(known > 0, known)).alias("of_verifiable"))


@query("a14_funnel", f"with {TASKS}, c as (select count(*) as a, count_if(quality is not null) as b, count_if(quality = 1) as c, count_if(quality = 1 and toxic = 0) as e, count_if(quality = 1 and toxic = 0 and category = 'en') as f from tasks) select unnest(['all','reviewed','good','safe','english']) as stage, unnest([a, b, c, e, f]) as n from c")
def _(s: SparkSession, d: str) -> DataFrame:
    q = F.coalesce(F.col("quality") == 1, F.lit(False))
    return A.funnel(tasks(s, d), {"all": F.lit(True), "reviewed": F.col("quality").isNotNull(), "good": q, "safe": F.coalesce(F.col("toxic") == 0, F.lit(False)), "english": F.col("category") == "en"})


@query("a15_length_statistics", "select role, count(*) as n, list_sort(list(length(text)))[count(*) // 2 + 1] as median, max(length(text)) as largest from conversations group by role")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.upper_median(table(s, d, "conversations").select("role", F.char_length("text").cast("long").alias("len")), "len", "role")


@query("a16_drop_ledger", T + "select case when n_calls = 0 then 'harness_error' when collateral then 'collateral' when not success_p then 'failed' when n_calls >= 7 then 'truncated' else 'kept' end as reason, count(*) as n from trials group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.ledger(trials(s, d), F.when(F.col("n_calls") == 0, "harness_error").when(F.col("collateral"), "collateral").when(~F.col("success_p"), "failed").when(F.col("n_calls") >= 7, "truncated"))


@query("a17_logprob_parity", """with p as (select a.vec_id, unnest(a.embedding) as x, unnest(b.embedding) as y, unnest(range(64)) as i from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
dd as (select vec_id, x::double - y::double as dif from p where i % 2 = 0), o as (select list_sort(list(abs(dif))) as v, avg(abs(dif)) as m, max(abs(dif)) as x from dd),
sq as (select vec_id, sum(dif) as t from dd group by vec_id) select m as mean_abs, v[(0.99 * (len(v) - 1))::decimal(38, 6)::bigint + 1 - (case when (0.99 * (len(v) - 1))::bigint > 0.99 * (len(v) - 1) then 1 else 0 end)] as p99, x as max_abs, (select avg(t) from sq) as mean_sequence from o""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    z = pairs.select("vec_id", F.posexplode(F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))).alias("i", "dif")).where("i % 2 = 0")
    stats = z.agg(F.avg(F.abs("dif")).alias("mean_abs"), F.max(F.abs("dif")).alias("max_abs"))
    # the order statistic without gathering: count per value, then the first value whose running count passes the index
    values = z.groupBy(F.abs("dif").alias("v")).agg(F.count("*").alias("k"))
    bins = values.withColumn("bin", F.floor(F.col("v") * 64))
    base = bins.groupBy("bin").agg(F.sum("k").alias("k")).select("bin", F.sum("k").over(Window.partitionBy()).alias("n"), F.coalesce(F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = bins.join(base, "bin").select("v", "n", (F.col("base") + F.sum("k").over(Window.partitionBy("bin").orderBy("v"))).alias("upto"))
    p99 = run.where(F.col("upto") > F.floor(0.99 * (F.col("n") - 1))).agg(F.min("v").alias("p99"))
    seq = z.groupBy("vec_id").agg(F.sum("dif").alias("t")).agg(F.avg("t").alias("mean_sequence"))
    return A.side_by_side(stats, p99, seq)


@query("a18_throughput", "select date_trunc('hour', ts) as hour, count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6 + 1) as rate, sum(value) as total from events group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    wall = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg((F.count("*") / (wall + 1)).alias("rate"), F.sum("value").alias("total"))


@query("a20_discordant_pairs", T + "select success_p, success_r, count(*) as n from trials group by all")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.discordant(trials(s, d), "success_p", "success_r")


@query("a21_call_limits", T + "select unnest([16, 5, 4, 3, 2, 1])::bigint as max_calls, unnest([avg((success_p and n_calls <= 16)::int), avg((success_p and n_calls <= 5)::int), avg((success_p and n_calls <= 4)::int), avg((success_p and n_calls <= 3)::int), avg((success_p and n_calls <= 2)::int), avg((success_p and n_calls <= 1)::int)]) as rate from trials")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.limited_success(trials(s, d), "success_p", "n_calls", [16, 5, 4, 3, 2, 1])


@query("a22_first_last_updates", T + ", u as (select day, avg(reward_p) as m, row_number() over (order by day) as a, row_number() over (order by day desc) as z from trials group by day) select avg(m) filter (a <= 8) as first_8, avg(m) filter (z <= 8) as last_8, count(*) as updates from u")
def _(s: SparkSession, d: str) -> DataFrame:
    u = trials(s, d).groupBy("day").agg(F.avg("reward_p").alias("m"))
    first, last = (u.orderBy(o).limit(8).agg(F.avg("m").alias(n)) for o, n in ((F.col("day"), "first_8"), (F.desc("day"), "last_8")))
    return A.side_by_side(first, last, u.agg(F.count("*").alias("updates")))


@query("a23_stratified_summary", T + "select faulted, family, grouping_id(faulted, family) as grouping, count(*) as n, avg(success_p::int) as success from trials group by grouping sets ((), (faulted), (family))")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.stratified(trials(s, d), ["faulted", "family"], n=F.count("*"), success=A.rate(F.col("success_p")))


@query("i1_wilson_bounds", T + ", k as (select task_id, count(*) as n, count_if(success_p) as k from trials group by task_id) select task_id, (k/n::double + 3.8416/(2*n) - 1.96*sqrt((k/n::double)*(1-k/n::double)/n + 3.8416/(4*n*n)))/(1+3.8416/n) as lower, (k/n::double + 3.8416/(2*n) + 1.96*sqrt((k/n::double)*(1-k/n::double)/n + 3.8416/(4*n*n)))/(1+3.8416/n) as upper from k")
def _(s: SparkSession, d: str) -> DataFrame:
    k = trials(s, d).groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("success_p").alias("k"))
    return k.select("task_id", I.wilson(F.col("k"), F.col("n")).alias("lower"), I.wilson(F.col("k"), F.col("n"), upper=True).alias("upper"))


def _order(p: float) -> str:
    return f"round(v[least(len(v) - 1, floor({p} * len(v))::bigint) + 1], 9)"


@query("i2_bootstrap_macro", T + ", per as (select task_id, avg((success_p and not collateral)::int) as x from trials group by task_id)" + boot(7, "avg(x)") + f" select {_order(0.025)} as lo, {_order(0.5)} as mid, {_order(0.975)} as hi, 'draws' as method from v")
def _(s: SparkSession, d: str) -> DataFrame:
    per = trials(s, d).groupBy("task_id").agg(A.rate(F.col("success_p") & ~F.col("collateral")).alias("x"))
    return I.intervals(I.bootstrap(per, "task_id", "x", None, REPLICATES, 7), lo=0.025, mid=0.5, hi=0.975)


@query("i3_paired_macro_difference", T + ", per as (select task_id, avg(success_p::int) - avg(success_r::int) as x from trials group by task_id)" + boot(11, "avg(x)") + f" select {_order(0.1)} as lo80, {_order(0.9)} as hi80, {_order(0.025)} as lo95, {_order(0.975)} as hi95, (select round(avg(x), 9) from per) as difference, 'draws' as method from v")
def arm_comparison_report(s: SparkSession, d: str) -> DataFrame:
    per = trials(s, d).groupBy("task_id").agg((A.rate(F.col("success_p")) - A.rate(F.col("success_r"))).alias("x"))
    ends = I.intervals(I.bootstrap(per, "task_id", "x", None, REPLICATES, 11), lo80=0.1, hi80=0.9, lo95=0.025, hi95=0.975)
    return A.side_by_side(ends, per.agg(F.round(F.avg("x"), 9).alias("difference")))


@query("i4_pooled_difference", T + ", per as (select task_id, sum(success_p::int - success_r::int)::double as x, count(*) as k from trials group by task_id)" + boot(13, "sum(x) / sum(k)") + f" select {_order(0.1)} as lo80, {_order(0.9)} as hi80, {_order(0.025)} as lo95, {_order(0.975)} as hi95, (select round(sum(x) / sum(k), 9) from per) as difference, 'draws' as method from v")
def _(s: SparkSession, d: str) -> DataFrame:
    per = trials(s, d).groupBy("task_id").agg(F.sum(F.col("success_p").cast("double") - F.col("success_r").cast("double")).alias("x"), F.count("*").alias("k"))
    ends = I.intervals(I.bootstrap(per, "task_id", "x", "k", REPLICATES, 13), lo80=0.1, hi80=0.9, lo95=0.025, hi95=0.975)
    return A.side_by_side(ends, per.agg(F.round(F.sum("x") / F.sum("k"), 9).alias("difference")))


@query("i5_promotion_rule", T + ", c as (select config, avg(success_p::int) - avg(success_r::int) as gain, avg(collateral::int) as harm, count(*) as n from trials group by config) select config, gain >= 0.0 and harm <= 0.2 and n >= 100 as passes, bool_and(gain >= 0.0 and harm <= 0.2 and n >= 100) over () as promoted from c")
def _(s: SparkSession, d: str) -> DataFrame:
    c = trials(s, d).groupBy("config").agg((A.rate(F.col("success_p")) - A.rate(F.col("success_r"))).alias("gain"), A.rate(F.col("collateral")).alias("harm"), F.count("*").alias("n"))
    c = c.select("config", ((F.col("gain") >= 0) & (F.col("harm") <= 0.2) & (F.col("n") >= 100)).alias("passes"))
    return c.withColumn("promoted", F.bool_and("passes").over(Window.partitionBy()))  # one row for each configuration


@query("i6_gates", E + """, per as (select task_id, avg(safe::int) as x from episodes group by task_id)""" + boot(20260927, "avg(x)") + f""",
m as (select coalesce(avg(collateral::int) filter (not assigned), 0.0) as collateral, coalesce(avg((not success)::int) filter (observed), 0.0) as recovery, (select avg(x) from per) as safe, (select {_order(0.975)} from v) as upper,
count_if(n_calls >= 6 and not safe) / count(*)::double as unfinished, count_if(not success and n_calls > 0) / count(*)::double as failed, count_if(safe) as wins, (select avg(x) from (select avg(success::int) as x from episodes group by task_id)) as wider from episodes),
g as (select count(*) as n, count_if(varies) as varying, count_if(mixed) as mixed from (select count(distinct round_even(coalesce(reward, 0.0), 6)) > 1 as varies, count_if(safe) between 1 and count(*) - 1 as mixed from episodes group by task_id, config))
select round_even(collateral, 4) as collateral, round_even(recovery, 4) as recovery, case when greatest(collateral, recovery) < 0.2 then null when collateral >= recovery then 'collateral' else 'recovery_failure' end as headline, safe as safe_success_macro, upper,
safe between 0.2 and 0.8 and upper < 0.9 as headroom_gate, (varying / n::double + 3.8416 / (2 * n) - 1.96 * sqrt((varying / n::double) * (1 - varying / n::double) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) > 0.60 and mixed >= 0.20 * n as variance_gate,
safe between 0.2 and 0.8 and upper < 0.9 and unfinished >= 0.2 and wider - safe >= 0.15 as budget_gate, safe between 0.2 and 0.8 and upper < 0.9 and failed >= 0.2 as hard_gate, wins >= 27 as stop from m, g""")
def _(s: SparkSession, d: str) -> DataFrame:
    """All gates over one set of trials. Of the budget gate's two arms, the wider one counts successes that did damage."""
    e = episodes(s, d)
    c, fail = F.col, ~F.col("success")
    per = materialise(e.groupBy("task_id").agg(A.rate(c("safe")).alias("x"), A.rate(c("success")).alias("wide")), "per")
    upper = I.intervals(I.bootstrap(per, "task_id", "x", None, REPLICATES, 20260927), upper=0.975).drop("method")
    rates = e.agg(
        A.rate(c("collateral"), ~c("assigned"), 0.0).alias("collateral"), A.rate(fail, c("observed"), 0.0).alias("recovery"), A.rate((c("n_calls") >= 6) & ~c("safe")).alias("unfinished"), A.rate(fail & (c("n_calls") > 0)).alias("failed"), F.count_if("safe").alias("wins"),
    )
    means = per.agg(F.avg("x").alias("safe"), F.avg("wide").alias("wider"))
    groups = A.group_variation(e, ["task_id", "config"], "reward", "safe", "collateral", "assigned", "row_id").agg(F.count("*").alias("n"), F.count_if("varying").alias("varying"), F.count_if("mixed").alias("mixed"))
    m = A.side_by_side(rates, means, upper, groups)
    room = I.headroom(c("safe"), c("upper"))
    return m.select(
        F.bround("collateral", 4).alias("collateral"), F.bround("recovery", 4).alias("recovery"), I.headline(collateral=c("collateral"), recovery_failure=c("recovery")).alias("headline"), c("safe").alias("safe_success_macro"), "upper",
        room.alias("headroom_gate"), I.variance_gate(c("varying"), c("mixed"), c("n")).alias("variance_gate"), (room & (c("unfinished") >= 0.20) & (c("wider") - c("safe") >= 0.15)).alias("budget_gate"),
        (room & (c("failed") >= 0.20)).alias("hard_gate"), (c("wins") >= 27).alias("stop"),
    )


@query("i7_zero_defect_bound", "select source, count(*) as n, 1 - pow(0.05, 1.0 / count(*)) as bound from documents group by source")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bound", I.zero_defect_bound(F.col("n")))


@query("i8_triage", f"with {TASKS}, r as (select source, count_if(quality = 1 and toxic = 0) / count(*)::double as a, count_if(toxic = 1) as e, count(*) as n from tasks group by source) select source, a as admissible, case when a <= 0.25 or e > 0.5 * n then 'drop' when a >= 0.5 and e = 0 then 'proceed' else 'owner' end as decision from r")
def _(s: SparkSession, d: str) -> DataFrame:
    r = tasks(s, d).groupBy("source").agg((F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)) / F.count("*")).alias("admissible"), F.count_if(F.col("toxic") == 1).alias("e"), F.count("*").alias("n"))
    return r.select("source", "admissible", I.triage(F.col("admissible"), F.col("e"), F.col("e") > 0.5 * F.col("n")).alias("decision"))
