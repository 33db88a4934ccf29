"""Queries over sources and sinks, training sets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.columns import attempt_seed, basename, command_of, dirname, extension, h12, seed_for
from trialspark.operators import aggregates as A
from trialspark.operators import training as B
from trialspark.operators import windows as W
from trialspark.plans.summaries import T
from trialspark.plans.views import STEPS, steps, table, trials
from trialspark.shared import new_path
from trialspark.sources import digest_tree as DT
from trialspark.sources import readers as R
from trialspark.sources.archives import archive_members
from trialspark.streaming import monitors as X

Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def H(text: str, n: int = 12) -> str:
    return f"('0x' || substr(sha256({text}), 1, {n}))::bigint"


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


@query("s1_json_lines", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "orders-json")
    orders(s, d).select("o_orderkey", "o_custkey", "o_orderstatus").write.json(path)
    return R.json_lines(s, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("s3_projected_scan", "select l_partkey, sum(l_quantity) as quantity from lineitem group by l_partkey")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.columns(s, f"{d}/lineitem.parquet", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))


@query("s7_override_merge", "select o_orderkey, case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end as price from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    one = orders(s, d).select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("seq"))
    two = one.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + 1)
    return R.overridden([one, two], "o_orderkey", "seq").drop("seq")


@query("s8_exclusive_merge", "select o_orderkey, o_orderkey % 2 as half from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d).select("o_orderkey", (F.col("o_orderkey") % 2).alias("half"))
    return R.exclusive([o.where("half = 0"), o.where("half = 1")], "o_orderkey")


@query("s9_resume", "select o_orderkey from orders where o_orderkey % 4 <> 0")
def _(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d).select("o_orderkey")
    return R.todo(o, o.where("o_orderkey % 4 = 0"), "o_orderkey")


@query("s10_identity_guard", "select count(*) as rows from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    done = orders(s, d).withColumn("identity", F.struct(F.lit("m1").alias("model"), F.lit("v4").alias("harness")))
    R.refuse_other_identity(done, {"model": "m1", "harness": "v4"})
    return done.agg(F.count("*").alias("rows"))


@query("s11_write_once", "select c_custkey from customer")
def _(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "customers")
    R.write_once(table(s, d, "customer").select("c_custkey"), path)
    return s.read.parquet(path)


@query("s13_row_digest", "select count(*) as n, sum(('0x' || substr(sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || '}'), 1, 15))::hugeint) as digest from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.row_digests(orders(s, d).select("o_orderkey", "o_custkey"))


@query("s14_tree_digest", "select source, substr(sha256(string_agg(lpad(doc_id::varchar, 12, '0') || ':' || sha256(text), chr(10) order by doc_id)), 1, 16) as digest from documents group by source")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.tree_digest(table(s, d, "documents").withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "source", "path", "text")


@query("s14_large_tree_digest", """with f as (select source, lpad(doc_id::varchar, 12, '0') as p, sha256(text) as h from documents), parts as (select source, substr(sha256(p), 1, 4) as part, sha256(string_agg(p || ':' || h, chr(10) order by p)) as h from f group by all)
select source, substr(sha256(string_agg(part || ':' || h, chr(10) order by part)), 1, 16) as digest from parts group by source""")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.large_tree_digest(table(s, d, "documents").withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "source", "path", "text")


@query("s4_task_bundles", r"select 'task_' || item_id as task_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as instruction, 1::bigint as test_files from benchmark where item_id % 3 <> 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every item of benchmark is written as a task folder, a third of them without tests; those do not count."""
    root = new_path(s, "bundles")
    b = table(s, d, "benchmark").select(F.concat(F.lit("task_"), "item_id").alias("task_id"), F.concat(F.lit(" \n"), "text", F.lit("\n")).alias("instruction"), F.when(F.col("item_id") % 3 != 0, "def test_state():\n    assert True\n").alias("test"))
    R.write_bundles(b, root).write.format("noop").mode("overwrite").save()
    return R.task_bundles(s, root)


@query("s6_archive_members", """with f as (select item_id % 4 as archive, item_id, case when item_id % 5 = 0 then '%post pip install x ' else '%post ' end || text as def, case when item_id % 3 = 0 then '[]' else '[1]' end as solutions from benchmark)
select archive || '.zip' as archive, count(*) as tasks, count_if(contains(def, 'pip install')) as network, count_if(strlen(solutions) > 2) as solved, sum(strlen(def) + strlen(solutions) + 2)::bigint as bytes from f group by all""")
def _(s: SparkSession, d: str) -> DataFrame:
    """benchmark as zip archives of task folders, and counts over their members' names, texts and sizes."""
    root, item = new_path(s, "archives"), F.col("item_id").cast("string")
    definition = F.concat(F.when(F.col("item_id") % 5 == 0, "%post pip install x ").otherwise("%post "), "text")
    solutions = F.when(F.col("item_id") % 3 == 0, "[]").otherwise("[1]")
    entry = lambda name, text: F.struct(F.concat(item, F.lit(name)).alias("member"), text.alias("text"))
    files = table(s, d, "benchmark").select((F.col("item_id") % 4).alias("part"), F.explode(F.array(entry("/task.json", F.lit("{}")), entry("/container.def", definition), entry("/solutions/summary.json", solutions))).alias("f")).select("part", "f.*")
    R.write_archives(files, "part", root).write.format("noop").mode("overwrite").save()
    m, name = archive_members(s, f"{root}/*.zip"), F.col("member")
    return m.groupBy("archive").agg(
        F.count_if(name.endswith("/task.json")).alias("tasks"), F.count_if(name.endswith("/container.def") & F.col("text").contains("pip install")).alias("network"),
        F.count_if(name.endswith("/solutions/summary.json") & (F.col("size") > 2)).alias("solved"), F.sum("size").alias("bytes"),
    )


@query("s12_atomic_publish", "select c_custkey, c_nationkey from customer where c_nationkey % 2 = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Published twice; readers see the second version only."""
    path, c = new_path(s, "contracts"), table(s, d, "customer").select("c_custkey", "c_nationkey")
    R.publish(c, path)
    R.publish(c.where("c_nationkey % 2 = 1"), path)
    return R.json_lines(s, R.published(s, path), "c_custkey long, c_nationkey long")


@query("s15_tree_drift", "select doc_id::varchar as path, case when doc_id % 13 = 0 then 'missing' else 'changed' end as state from documents where doc_id % 13 = 0 or doc_id % 17 = 0 union all select 'new/' || doc_id, 'added' from documents where doc_id % 19 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """A stored tree of digests of all texts, brought up to date by changed, removed and new files, against what it was."""
    files = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"))
    gone = F.when(F.col("doc_id") % 13 != 0, F.sha2(F.concat_ws("", "digest", F.lit("!")), 256))
    changes = files.where("doc_id % 13 = 0 or doc_id % 17 = 0").select("path", gone.alias("digest"))
    new = files.where("doc_id % 19 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "digest")
    before = DT.build(files, "path", "digest", new_path(s, "tree"))
    return DT.differences(s, before, DT.update(s, before, changes.union(new), "path", "digest"))


@query("s15_hash_drift", "select doc_id, case when doc_id % 13 = 0 then 'missing' else 'changed' end as state from documents where doc_id % 13 = 0 or doc_id % 17 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    recorded = docs.select("doc_id", F.when(F.col("doc_id") % 17 == 0, "0").otherwise(F.sha2("text", 256)).alias("digest"))
    return R.drift(recorded, docs.where("doc_id % 13 <> 0"), "doc_id", "text")


@query("s16_public_export", "select c_custkey::varchar as key, '{\"segment\":\"' || c_mktsegment || '\",\"reason\":\"' || case c_nationkey % 2 when 0 then 'even' else 'odd' end || '\"}' as record from customer")
def _(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.concat(F.lit("private/"), "c_custkey").alias("id"), "c_mktsegment", (F.col("c_nationkey") % 2).cast("string").alias("code"))
    return R.public_export(c, {"id": "key", "c_mktsegment": "segment", "code": "reason"}, "private/", {"0": "even", "1": "odd"}, "record")


@query("f1_f3_hashes_and_paths", f"select o_orderkey, {H(chr(39) + 'a:' + chr(39) + ' || o_orderkey')} as h, {H('o_orderkey::varchar', 8)} as seed, 1000 * (o_orderkey % 4) + {H(chr(39) + 'b:' + chr(39) + ' || o_orderkey', 6)} % 1000 as attempt, o_orderkey || '.txt' as base, '/data/' || o_custkey as folder, 'txt' as ext from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import hash_of

    k, path = F.col("o_orderkey"), F.concat(F.lit("/data/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".txt"))
    return orders(s, d).select("o_orderkey", h12("a", k).alias("h"), seed_for(k).alias("seed"), attempt_seed(k % 4, hash_of("b", k)).alias("attempt"), basename(path).alias("base"), dirname(path).alias("folder"), extension(path).alias("ext"))


@query("f4_f6_order_statistics", "select l_orderkey, list_sort(list(l_quantity))[least(len(list(l_quantity)) - 1, floor(0.9 * count(*))::bigint) + 1] as p90, round_even(max(l_quantity) / 8, 2) as eighth from lineitem group by l_orderkey")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import half_even

    lines = table(s, d, "lineitem")
    eighth = lines.groupBy("l_orderkey").agg(half_even(F.max("l_quantity") / 8, 2).alias("eighth"))
    return A.order_statistics(lines, "l_orderkey", "l_quantity", p90=0.9).join(eighth, "l_orderkey")


@query("f9_command_arguments", "select event_id, json_extract_string(props, '$.ref') as command from events")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.ref").alias("command"))).alias("arguments"))
    return e.select("event_id", command_of(F.col("arguments")).alias("command"))


@query("b1_safe_success", T + "select row_id from trials where success_p and not collateral and n_calls > 0 and n_calls < 7")
def _(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_calls")
    end = F.when(n >= 7, "truncated").otherwise("stopped")
    return trials(s, d).where(B.safe_success(F.col("success_p"), F.col("collateral"), n == 0, n >= 7, n > 0, end)).select("row_id")


TOKENS = "t as (select conv_id, turn, role, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') as w from conversations)"


def conversation(s: SparkSession, d: str) -> DataFrame:
    return B.conversation_tokens(table(s, d, "conversations"), "conv_id", "turn", "role", "text", ["assistant"])


@query("b3_conversation_tokens", f"with {TOKENS} select conv_id, sum(len(w))::bigint as n_tokens, coalesce(sum(len(w)) filter (role = 'assistant'), 0)::bigint as trained, sha256(string_agg(array_to_string(w, ' '), ' ' order by turn) filter (len(w) > 0)) as digest from t group by conv_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return conversation(s, d).select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("trained"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


@query("b2_sequence_assembly", f"with {TOKENS}, c as (select conv_id, sum(len(w))::bigint as n, coalesce(sum(len(w)) filter (role = 'assistant'), 0)::bigint as a from t group by conv_id) select conv_id, n + 4 as length, a as supervised, n + 4 > 200 as too_long from c")
def _(s: SparkSession, d: str) -> DataFrame:
    c = conversation(s, d).withColumn("prompt", F.array(*map(F.lit, ("a", "b", "c", "d"))))
    return B.assembled(c, "prompt", "tokens", "mask", 200).select("conv_id", F.size("ids").cast("long").alias("length"), "supervised", "too_long")


@query("b4_demonstrations", T + ", r as (select *, row_number() over (partition by task_id order by row_id) as i from trials where success_p and not collateral) select task_id, row_id, n_calls from r where i <= 2 and n_calls < 7 and n_calls > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_calls")
    e = F.struct("row_id", (F.col("success_p") & ~F.col("collateral")).alias("passed"), F.when(n >= 7, "truncated").when(n == 0, "harness_error").otherwise("stopped").alias("end"), "n_calls")
    records = trials(s, d).groupBy("task_id").agg(F.array_sort(F.collect_list(e)).alias("episodes"))
    return B.demonstrations(records, "task_id", "episodes", 2, ["truncated", "harness_error"]).select("task_id", "row_id", "n_calls")


@query("b5_verified_extraction", T + ", f as (select *, row_number() over (partition by task_id, config order by row_id) as i from trials) select case when i > 1 then 'replay' when collateral then 'collateral' when not success_p then 'failed' else 'kept' end as reason, count(*) as n from f group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    t = trials(s, d).withColumn("attempt", F.concat_ws(":", "task_id", "config"))
    first = W.first_by(t, "attempt", "row_id").select("row_id", F.lit(True).alias("first"))
    from trialspark.operators.aggregates import ledger

    return ledger(t.join(first, "row_id", "left"), F.when(F.col("first").isNull(), "replay").when(F.col("collateral"), "collateral").when(~F.col("success_p"), "failed"))


@query("b6_length_batches", f"with o as (select conv_id, row_number() over (order by h, conv_id) - 1 as i, n from (select conv_id, {H(chr(39) + 'b6:' + chr(39) + ' || conv_id')} as h, sum(length(text)) as n from conversations group by conv_id)) select i // 8 as batch, count(*) as sequences, sum(n)::bigint as tokens from o group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n"))
    return B.batches(c, h12("b6", F.col("conv_id")), "conv_id", 8).groupBy("batch").agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"))


@query("b7_user_messages", "select doc_id, sha256(text || case when doc_id % 2 = 0 then '' else chr(10) || chr(10) || 'You may use at most ' || (doc_id % 16) || ' commands.' end) as digest, 2 as messages from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    p = B.prompt("Be brief.", B.user_message(F.col("text"), F.when(k % 2 == 1, k % 16)))
    return table(s, d, "documents").select("doc_id", p.alias("p")).select("doc_id", F.sha2(F.element_at("p", -1)["content"], 256).alias("digest"), F.size("p").alias("messages"))


@query("b8_strip_padding", "select vec_id, len(embedding) - vec_id % 5 as kept from embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    ids = F.transform("embedding", lambda x, i: F.when(i < 64 - F.col("vec_id") % 5, i + 1).otherwise(0))
    return table(s, d, "embeddings").select("vec_id", F.size(B.without_padding(ids, 0)).cast("long").alias("kept"))


def drained(stream: DataFrame, mode: str = "append", timers: bool = False) -> DataFrame:
    """All that a stream yields once it has read what is there, as a written table."""
    s = stream.sparkSession
    out, state = new_path(s, "stream"), new_path(s, "state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    with X.disk_state(s, drain=timers):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query("x1_ingest_without_replays", "select event_id, user_id from events")
def _(s: SparkSession, d: str) -> DataFrame:
    e = replayable(s, d).select("event_id", "user_id", "ts")
    replayed = e.withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return drained(X.ingest(replayed, "event_id", "ts")).select("event_id", "user_id")


def replayable(s: SparkSession, d: str) -> DataFrame:
    """events written to a folder of its own, so that a file source can stream them."""
    path = new_path(s, "events")
    table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path)


@query("x2_latch", "select user_id as episode, min(event_id) as first_call, count(distinct event_id % 7) as damaged from events where event_type = 'error' group by user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    e = replayable(s, d).where("event_type = 'error'").select("user_id", "event_id", (F.col("event_id") % 7).cast("string").alias("path"))
    return X.latched(drained(X.latch(e, "user_id", "event_id", "path"), "update", timers=True))


STOPS = f"""with {STEPS}, w as (select user_id as run, step, row_number() over r as n, sum(hours) over r as hours, min(zero) over (r rows between 2 preceding and current row) as z, not isfinite(value) or not isfinite(grad_norm) as broken,
avg(1 - zero) over (r rows between 31 preceding and current row) as i1, avg(1 - zero) over (r rows between 63 preceding and 32 preceding) as i2, avg(clipped) over (r rows between 7 preceding and current row) as t1,
avg(clipped) over (r rows between 15 preceding and 8 preceding) as t2 from steps window r as (partition by user_id order by step)),
f as (select run, step, case when n * 16 >= 1200 then 'trajectories' when hours > 40 then 'hours' when n >= 16 and n % 8 = 0 and t1 > 0.05 and t2 > 0.05 then 'truncated' when n >= 64 and n % 32 = 0 and i1 < 0.60 and i2 < 0.60 then 'informative'
when n >= 3 and z >= 1 then 'streak' when broken then 'not_finite' end as rule from w) select run, arg_min(rule, step) as rule, min(step) as step from f where rule is not null group by run"""
LOGGED = ("user_id", "loss", "grad_norm", "zero", "clipped", "hours")


@query("x3_liveness", STOPS)
def _(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "steps")
    steps(s, d).select(*LOGGED, F.col("step").cast("long").alias("step")).write.parquet(path)
    return drained(X.liveness(s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 10_000).parquet(path), "user_id", "step"), timers=True)


@query("x3_liveness_batch", STOPS)
def _(s: SparkSession, d: str) -> DataFrame:
    return X.stops(steps(s, d), "user_id", "step")


@query("x4_windowed_incidence", "select time_bucket(interval '1 hour', ts) as start, count(*) as n, count_if(event_type = 'error') as bad from events group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.incidence(e, "ts", F.col("event_type") == "error").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x4_windowed_incidence_stream")
def _(s: SparkSession, d: str) -> DataFrame:
    return drained(X.incidence(replayable(s, d), "ts", F.col("event_type") == "error"))


@query("x5_progress", "select count(*) as done, count_if(event_type = 'error') as errors from events")
def _(s: SparkSession, d: str) -> DataFrame:
    return drained(X.progress(replayable(s, d), F.col("event_type") == "error"), "update").agg(F.max("done").alias("done"), F.max("errors").alias("errors"))


def write_files(df: DataFrame, path: str) -> None:
    """One JSON file for each row, by all tasks, each of which moves its own files into place; a single one would write them one after the other."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // 1000))
    df.repartition(parts).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


@query("s2_record_folder", "select s_suppkey, s_nationkey, true as named from supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "records")
    write_files(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), path)
    r = R.record_folder(s, path, "s_suppkey long, s_nationkey long")
    return r.select("s_suppkey", "s_nationkey", F.col("key").startswith("part-").alias("named"))


@query("s5_text_files", "select count(*) as files, sum(length('{\"s_suppkey\":' || s_suppkey || ',\"s_nationkey\":' || s_nationkey || '}') + 1)::bigint as chars from supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "texts")
    write_files(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), path)
    files = R.text_files(s, path).where("path like '%.json'")
    return files.agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("chars"))


@query("f7_test_functions", "select l_orderkey, l_linenumber, 'test_' || l_partkey as function from lineitem")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import test_function

    nodeid = F.concat(F.lit("tests/a.py::TestA::test_"), "l_partkey", F.lit("[x-"), "l_suppkey", F.lit("]"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", test_function(nodeid).alias("function"))


@query("f8_f10_masks", f"with {TOKENS} select conv_id, sum(len(w))::bigint + 3 as length, coalesce(sum(len(w)) filter (role = 'assistant'), 0)::bigint as positions from t group by conv_id")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import joined_ids, joined_mask, supervised_positions

    p = F.array(*map(F.lit, ("a", "b", "c")))
    c = conversation(s, d).select("conv_id", joined_ids(p, F.col("tokens")).alias("ids"), joined_mask(p, F.col("mask")).alias("m"))
    return c.select("conv_id", F.size("ids").cast("long").alias("length"), F.size(supervised_positions(F.col("m"))).cast("long").alias("positions"))
