"""Queries over joins, predicates, windows, sorts, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import h12, hash_of
from trialspark.operators import aggregates as A
from trialspark.operators import assignment as S
from trialspark.operators import code as C
from trialspark.operators import containment as N
from trialspark.operators import joins as J
from trialspark.operators import windows as W
from trialspark.operators.grading import READ_ERRORS, fault_observed
from trialspark.plans.summaries import T
from trialspark.plans.texts import as_python
from trialspark.plans.views import MANIFESTS, STEPS, TASKS, TRIALS, manifests, steps, table, tasks, trials

Q: dict = {}
O: dict[str, str] = {}


def H(text: str, n: int = 12) -> str:
    return f"('0x' || substr(sha256({text}), 1, {n}))::bigint"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


FAMILIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def family_usable(s: SparkSession, d: str) -> DataFrame:
    """Customers with a map: order priority -> usable (some order of it above 200,000)."""
    o = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max((F.col("o_totalprice") > 200000).cast("int")).cast("boolean").alias("u"))
    return o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "u"))).alias("faults"))


USABLE = "u as (select o_custkey, o_orderpriority as f, max(o_totalprice) > 200000 as u from orders group by all)"


@query("p1_row_builder", "select o_custkey as task_id, c as config, a as attempt, 'v1:' || o_custkey || ':c' || c || ':a' || a as row_id from (select distinct o_custkey from orders), range(0, 2) x(c), range(0, 2) y(a)")
def _(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select(F.col("o_custkey").alias("task_id")).distinct()
    r = S.rows_of(t, "task_id", "v1", 2, 2)
    return r.select("task_id", F.col("config").cast("long").alias("config"), F.col("attempt").cast("long").alias("attempt"), "row_id")


@query("p2_eligibility", f"with {USABLE} select o_custkey, count(*) as families from u where o_custkey % 2 = 0 and o_custkey not in (select c_custkey from customer where c_custkey % 10 = 0) group by o_custkey having bool_or(u)")
def _(s: SparkSession, d: str) -> DataFrame:
    f = family_usable(s, d).where((F.col("o_custkey") % 2 == 0) & F.exists(F.map_values("faults"), lambda x: x))
    out = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return f.join(out, "o_custkey", "left_anti").select("o_custkey", F.size("faults").cast("long").alias("families"))


@query("p3_usable_families", f"with {USABLE} select o_custkey, coalesce(string_agg(f, ',' order by f) filter (u), '') as usable from u group by o_custkey")
def _(s: SparkSession, d: str) -> DataFrame:
    return family_usable(s, d).select("o_custkey", F.array_join(F.filter(F.array(*map(F.lit, FAMILIES)), lambda f: F.coalesce(F.try_element_at("faults", f), F.lit(False))), ",").alias("usable"))


@query("p4_contract_projection", f"with {USABLE}, m as (select o_custkey, count(*) as n, string_agg(f || '=' || f, ',' order by f) filter (u) as targets from u group by o_custkey) select o_custkey, targets from m where n >= 3 and targets is not null")
def _(s: SparkSession, d: str) -> DataFrame:
    f = family_usable(s, d).where(F.size("faults") >= 3)
    f = f.withColumn("targets", F.transform_values(F.map_filter("faults", lambda k, v: v), lambda k, v: k)).where(F.size("targets") > 0)
    return f.select("o_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("targets"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("targets"))


@query("p5_revalidation_reasons", T + ", r as (select row_id, list_filter([case when collateral then 'damage' end, case when n_calls = 0 then 'no_command' end, case when reward_p <> reward_r then 'unstable' end], lambda x: x is not null) as why from trials) select row_id, array_to_string(why, ',') as reasons from r where len(why) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    why = F.array_compact(F.array(F.when(F.col("collateral"), "damage"), F.when(F.col("n_calls") == 0, "no_command"), F.when(F.col("reward_p") != F.col("reward_r"), "unstable")))
    return trials(s, d).select("row_id", why.alias("why")).where(F.size("why") > 0).select("row_id", F.array_join("why", ",").alias("reasons"))


CALLS = """calls as (select conv_id, turn, ['perm_denied', 'moved_input', 'missing_tool', 'blocking_fifo', 'other'][conv_id % 5 + 1] as family, '/data/' || case when turn % 2 = 0 then coalesce(regexp_extract(text, '[a-z]{4,}'), '') else 'absent.csv' end as target, text as command,
case (conv_id + turn) % 7 when 0 then text || ' cannot open' when 1 then '  ---------- 1 u ' || regexp_extract(text, '[a-z]{4,}') when 2 then '/data/' || coalesce(regexp_extract(text, '[a-z]{4,}'), '') || ': command not found' when 3 then 'absent.csv: Permission denied' else 'ok' end as output, turn % 3 = 0 as timed_out from conversations)"""
ERRORS = " or ".join(f"contains(output, '{x.replace(chr(39), chr(39) * 2)}')" for x in READ_ERRORS)


@query("p6_fault_observed", f"with {CALLS}, b as (select *, regexp_extract(target, '[^/]*$') as base, {ERRORS} as error from calls)" + """ select conv_id, turn, case family when 'perm_denied' then (contains(command, base) or contains(output, base)) and (error or (starts_with(ltrim(output), '----------') and contains(output, base)))
when 'moved_input' then (contains(command, base) or contains(output, base)) and error when 'missing_tool' then contains(output, target) and (contains(output, 'command not found') or contains(output, 'No such file') or contains(output, 'not found'))
when 'blocking_fifo' then timed_out and (contains(command, base) or contains(output, base)) else false end as observed, family from b""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Turns as commands with a word of theirs as the target; the tools' outputs, which the tables do not hold, are made up by key."""
    c = table(s, d, "conversations")
    word, at = F.regexp_extract("text", "[a-z]{4,}", 0), (F.col("conv_id") + F.col("turn")) % 7
    families = F.array(*map(F.lit, ("perm_denied", "moved_input", "missing_tool", "blocking_fifo", "other")))
    target = F.concat(F.lit("/data/"), F.when(F.col("turn") % 2 == 0, word).otherwise("absent.csv"))
    output = (
        F.when(at == 0, F.concat("text", F.lit(" cannot open"))).when(at == 1, F.concat(F.lit("  ---------- 1 u "), word)).when(at == 2, F.concat(F.lit("/data/"), word, F.lit(": command not found")))
        .when(at == 3, "absent.csv: Permission denied").otherwise("ok")
    )
    family = F.get(families, (F.col("conv_id") % 5).cast("int"))
    return c.select("conv_id", "turn", fault_observed(family, target, F.col("text"), output, F.col("turn") % 3 == 0).alias("observed"), family.alias("family"))


@query("p7_input_candidates", f"with {MANIFESTS}, m as (select p_brand, p_brand || ' ' || string_agg(p_partkey::varchar, ' ' order by p_partkey) filter (p_partkey % 4 = 0) as instruction from parts group by p_brand) select path from (select '/home/user/' || p.p_brand || '/' || p.p_partkey as path from parts p join m using (p_brand) where contains(' ' || instruction || ' ', ' ' || p_partkey || ' ')) where path not in (select entry from permits)")
def _(s: SparkSession, d: str) -> DataFrame:
    before, _, permits = manifests(s, d)
    files = before.select("path", F.element_at(F.split("path", "/"), -2).alias("brand"), F.element_at(F.split("path", "/"), -1).alias("base"))
    named = files.where(F.col("base").cast("long") % 4 == 0).groupBy("brand").agg(F.array_join(F.collect_list("base"), " ").alias("instruction"))
    hits = J.mentioned(files, "brand", "path", named, "instruction")
    return hits.select("path").join(permits.select(F.col("entry").alias("path")), "path", "left_anti")


@query("p8_unfinished", T + "select task_id, count_if(n_calls >= 7 and not success_p) as unfinished from trials group by task_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return trials(s, d).groupBy("task_id").agg(F.count_if((F.col("n_calls") >= 7) & ~F.col("success_p")).alias("unfinished"))


@query("p9_verdict_reasons", T + "select row_id, case when n_calls >= 7 then 'truncated' when collateral then 'collateral' when not success_p then 'failed' else 'kept' end as verdict from trials")
def _(s: SparkSession, d: str) -> DataFrame:
    return trials(s, d).select("row_id", F.when(F.col("n_calls") >= 7, "truncated").when(F.col("collateral"), "collateral").when(~F.col("success_p"), "failed").otherwise("kept").alias("verdict"))


@query("p10_constant_guard", "select count(distinct coalesce(o_orderstatus, '-1')) = 1 as constant, count(distinct coalesce(o_orderstatus, '-1')) as n_values from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct(F.coalesce("o_orderstatus", F.lit("-1")))
    return table(s, d, "orders").agg((n == 1).alias("constant"), n.alias("n_values"))


@query("p11_admission_decision", f"with {TASKS} select task_id, coalesce(quality = 1, false) as reviewed_good, coalesce(toxic = 1, false) as exposed, coalesce(quality = 1 and toxic = 0, false) as admitted from tasks")
def _(s: SparkSession, d: str) -> DataFrame:
    good, exposed = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("quality", "toxic"))
    return tasks(s, d).select("task_id", good.alias("reviewed_good"), exposed.alias("exposed"), (good & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("admitted"))


@query("p12_pool_exclusions", "select doc_id from documents where not contains(text, 'token') and doc_id not in (select doc_id from labels where doc_id is not null)")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(~F.col("text").contains("token")).select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti")


@query("p13_licence_ledger", "select source, case when count_if(contains(text, 'icensed under')) > 0 then 'resolved' else 'open' end as status, count(*) as records, sum(strlen(text))::bigint as bytes from documents where source is not null group by source")
def _(s: SparkSession, d: str) -> DataFrame:
    has = F.max(F.col("text").contains("icensed under").cast("int")) == 1
    return table(s, d, "documents").where("source is not null").groupBy("source").agg(F.when(has, "resolved").otherwise("open").alias("status"), F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"))


ARM = "arm as (select row_id, case when row_id % 97 = 0 then 'other' else coalesce(family, '-') end as family from trials where row_id % 50 <> 0 union all select row_id, coalesce(family, '-') from trials where row_id % 40 = 1 union all select -row_id, '-' from trials where row_id % 60 = 0)"


@query("j1_arm_join", T + f", {ARM}, a as (select row_id, count(*) as n, min(family) as lo, max(family) as hi from arm group by row_id) select count_if(n > 1) as duplicates, count_if(n is null) as missing, count_if(t.row_id is null) as unexpected, count_if(t.row_id is not null and n is not null and (coalesce(t.family, '-') <> lo or coalesce(t.family, '-') <> hi)) as mismatched from trials t full join a on a.row_id = t.row_id")
def _(s: SparkSession, d: str) -> DataFrame:
    t = trials(s, d).select("row_id", F.coalesce("family", F.lit("-")).alias("family"))
    arm = t.where("row_id % 50 <> 0").withColumn("family", F.when(F.col("row_id") % 97 == 0, "other").otherwise(F.col("family")))
    arm = arm.union(t.where("row_id % 40 = 1")).union(t.where("row_id % 60 = 0").select(-F.col("row_id"), F.lit("-")))
    return J.arm_report(t, arm, "row_id", "family")


@query("j2_paired_join", T + "select a.row_id, a.reward_p as treatment, b.reward_r as control from trials a join trials b on a.row_id = b.row_id")
def _(s: SparkSession, d: str) -> DataFrame:
    t = trials(s, d)
    return t.select("row_id", F.col("reward_p").alias("treatment")).join(t.select("row_id", F.col("reward_r").alias("control")), "row_id")


@query("j3_record_review_static", f"with {TASKS} select task_id, case when quality is null then 'pending' when quality = 1 then 'admit' else 'reject' end as review, length(instruction) as chars from tasks")
def _(s: SparkSession, d: str) -> DataFrame:
    return tasks(s, d).select("task_id", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "admit").otherwise("reject").alias("review"), F.char_length("instruction").cast("long").alias("chars"))


@query("j4_prefixed_id_join", "select count(*) as matched, (select count(*) from labels) as labels from labels join documents using (doc_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    label = table(s, d, "labels").select(F.concat(F.lit("pool/"), "doc_id").alias("id"))
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    both = label.withColumn("id", F.regexp_replace("id", "^pool/", "")).join(docs, "id")
    return A.side_by_side(both.agg(F.count("*").alias("matched")), label.agg(F.count("*").alias("labels")))


@query("j5_semi_anti", "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey) then 'used' else 'new' end as state from customer")
def _(s: SparkSession, d: str) -> DataFrame:
    c, used = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(used, "c_custkey", "left_semi").withColumn("state", F.lit("used")).union(c.join(used, "c_custkey", "left_anti").withColumn("state", F.lit("new")))


@query("j6_prefix_join", f"with {MANIFESTS} select b.path, string_agg(distinct kind, ',' order by kind) as kinds from before b join permits p on p.entry = b.path or (p.entry like '%/' and starts_with(b.path, p.entry)) group by b.path")
def _(s: SparkSession, d: str) -> DataFrame:
    before, _, permits = manifests(s, d)
    return J.prefix_join(before.select("path"), permits).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


LINES = "select distinct {key}, trim(line, ' ') as line from (select {key}, unnest(string_split({text}, chr(10))) as line from {table}) where length(trim(line, ' ')) >= 18"


#: Where a literal counts: not in Dockerfiles, nor in files of tests.
VISIBLE = "name <> 'Dockerfile' and not starts_with(name, 'test_') and not starts_with(name, 'task.json') and not starts_with(name, 'task_summary')"
NAMED = "case doc_id % 10 when 0 then 'Dockerfile' when 1 then 'test_' || doc_id || '.py' when 2 then 'task.json' else 'f' || doc_id || '.txt' end"


@query("j7_literal_containment", f"""with b as (select distinct line from ({LINES.format(key='item_id', text='text', table='benchmark')}) where regexp_matches(line, '[A-Za-z]{{4}}') and not starts_with(line, '/') and not starts_with(line, 'http')),
f as (select doc_id, text, {NAMED} as name from documents) select line, min(name) as first_file, count(distinct doc_id) as files from b join f on contains(f.text, b.line) where {VISIBLE} group by line""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Literals of verifiers (the items of benchmark as string constants) anywhere in the files that a task shows."""
    tests = table(s, d, "benchmark").select("item_id", F.concat(F.lit("# a comment that is no literal at all\nX = "), as_python(F.col("text")), F.lit("\n")).alias("test"))
    files = table(s, d, "documents").select("doc_id", "text", F.expr(NAMED).alias("name")).where(F.expr(VISIBLE.replace("starts_with", "startswith")))
    found = N.containing(files.select(F.struct("name", "doc_id").alias("file"), "text"), "file", "text", C.literal_lines(tests, "item_id", "test"), "line")
    return found.groupBy("line").agg(F.min("file.name").alias("first_file"), F.count_distinct("file.doc_id").alias("files"))


@query("j7_literal_anywhere", f"with b as (select distinct line from ({LINES.format(key='item_id', text='text', table='benchmark')})) select line, min(doc_id) as first_doc, count(distinct doc_id) as docs from b join documents d on contains(d.text, b.line) group by line")
def _(s: SparkSession, d: str) -> DataFrame:
    literals = J.lines_in(table(s, d, "benchmark"), "item_id", "text", 18)
    return N.containing(table(s, d, "documents"), "doc_id", "text", literals, "line").groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("docs"))


FLAT = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'), ' ')"


@query("j8_expected_block", rf"""with f as (select doc_id, text, case when doc_id % 3 = 1 then substr(text, 2) || 'x' else text end as v from documents where doc_id % 3 <> 2 and doc_id % 11 <> 0)
select doc_id, case when doc_id % 3 = 1 then 'self.expected_text' else 'EXPECTED' end as variable from f where length(v) >= 40 and regexp_matches(trim(v, E' \t\r\n'), '[\r\n]') and contains({FLAT.format('text')}, {FLAT.format('v')})""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Documents as instructions, whose verifiers assign the text as a list of lines or a changed text as a string to a name with
    expected in it, or the text to another name; one in eleven does not parse."""
    k, lines = F.col("doc_id"), F.to_json(F.split("text", "\n"))
    test = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("EXPECTED = "), lines)).when(k % 3 == 1, F.concat(F.lit("self.expected_text: str = "), F.expr("rtrim(']', substr(to_json(array(substr(text, 2) || 'x')), 2))"))).otherwise(F.concat(F.lit("result = "), lines)),
        F.lit("\ndef test_a():\n    expected_n = 3\n"), F.when(k % 11 == 0, "  broken(").otherwise(""),
    )
    tasks = table(s, d, "documents").select("doc_id", "text", test.alias("test"))
    blocks = C.expected_blocks(tasks, "doc_id", "test")
    return blocks.join(tasks.select("doc_id", C.squeezed(F.col("text")).alias("shown")), "doc_id").where(F.col("shown").contains(F.col("block"))).select("doc_id", "variable")


@query("j8_whole_block", rf"select item_id, doc_id from benchmark b join documents d on contains({FLAT.format('d.text')}, {FLAT.format('b.text')}) where length(b.text) >= 40 and regexp_matches(trim(b.text, E' \t\r\n'), '[\r\n]')")
def _(s: SparkSession, d: str) -> DataFrame:
    blocks = table(s, d, "benchmark").where(J.is_block(F.col("text"))).select("item_id", J.flat(F.col("text")).alias("block"))
    docs = table(s, d, "documents").select("doc_id", J.flat(F.col("text")).alias("text"))
    return blocks.join(N.containing(docs, "doc_id", "text", blocks, "block"), "block").select("item_id", "doc_id")


@query("j9_label_join", "select l_orderkey, bool_or(p_size > 25) as substantive, count(*) as failures from lineitem join part on p_partkey = l_partkey where l_returnflag = 'N' group by l_orderkey")
def _(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", F.concat(F.lit("tests/t.py::p"), "l_partkey", F.lit("[x]")).alias("nodeid"))
    from trialspark.functions.columns import test_function

    label = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("function"), (F.col("p_size") > 25).alias("substantive"))
    return nodes.withColumn("function", test_function(F.col("nodeid"))).join(label, "function").groupBy("l_orderkey").agg(F.bool_or("substantive").alias("substantive"), F.count("*").alias("failures"))


@query("j10_date_ranges", "select case when o_orderdate < '1994-01-01' then 'v2' when o_orderdate < '1996-07-01' then 'v3' else 'v4' end as licence, count(*) as n from orders group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    ranges = s.createDataFrame([("v2", "0001-01-01", "1994-01-01"), ("v3", "1994-01-01", "1996-07-01"), ("v4", "1996-07-01", "9999-01-01")], "licence string, lo string, hi string")
    ranges = ranges.select("licence", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return J.range_join(table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), ranges, "day").groupBy("licence").agg(F.count("*").alias("n"))


@query("j11_exact_overlap", r"with n as (select doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '))) as h from documents), b as (select sha256(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '))) as h, 'benchmark' as reference from benchmark union all select h, 'labelled' from n join labels using (doc_id)) select reference, count(distinct doc_id) as matches from n join b using (h) group by reference")
def _(s: SparkSession, d: str) -> DataFrame:
    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("h", F.sha2(F.lower(J.flat(F.col("text"))), 256))

    docs = hashed(table(s, d, "documents")).select("doc_id", "h")
    sets = hashed(table(s, d, "benchmark")).select("h", F.lit("benchmark").alias("reference")).union(docs.join(table(s, d, "labels"), "doc_id", "left_semi").select("h", F.lit("labelled")))
    return docs.join(sets.distinct(), "h").groupBy("reference").agg(F.count_distinct("doc_id").alias("matches"))


GRAMS = r"select distinct {key}, array_to_string(w[i:i+12], ' ') as gram from (select {key}, w, unnest(range(1, len(w) - 11)) as i from (select {key}, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') as w from {table}) where len(w) >= 13)"


@query("j12_ngram_overlap", f"with g as ({GRAMS.format(key='doc_id', table='documents')}), b as (select distinct gram from ({GRAMS.format(key='item_id', table='benchmark')})) select doc_id, count(*) as grams, count(b.gram) as shared, count(b.gram) / count(*)::double as overlap from g left join b using (gram) group by doc_id having count(b.gram) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.shared_grams(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "text", 13).withColumn("overlap", F.col("shared") / F.col("grams"))


@query("w1_first_by_hash", f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by {H(chr(39) + 'w:' + chr(39) + ' || doc_id')}, doc_id) as rn from documents) where rn = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return W.first_by(table(s, d, "documents"), "source", h12("w", F.col("doc_id")), "doc_id").select("source", "doc_id")


@query("w2_tiered_cap", "select o_custkey, o_orderkey, greatest(rn, 2) as tier from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn <= 4")
def _(s: SparkSession, d: str) -> DataFrame:
    t = W.tiered(table(s, d, "orders"), "o_custkey", "o_orderkey", 2, 4)
    return t.select("o_custkey", "o_orderkey", F.col("tier").cast("long").alias("tier"))


@query("w3_collateral_latch", "with f as (select l_orderkey, min(l_linenumber) as first_call from lineitem where l_discount > 0.05 group by 1) select l.l_orderkey, f.first_call, array_to_string(list_sort(list(l_partkey::varchar) filter (l_linenumber = first_call))[1:20], ',') as events, count(distinct l_suppkey) as n_damaged from lineitem l join f using (l_orderkey) where l_discount > 0.05 group by 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    bad = table(s, d, "lineitem").where("l_discount > 0.05").withColumn("part", F.col("l_partkey").cast("string"))
    x = W.latch(bad, "l_orderkey", "l_linenumber", "part", "l_suppkey", 20)
    return x.withColumn("events", F.array_join("events", ","))


@query("w4_first_attempt", "select o_custkey % 500 as attempt_id, min(o_orderkey) as row_id, count(*) - 1 as replays from orders group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select((F.col("o_custkey") % 500).alias("attempt_id"), F.col("o_orderkey").alias("row_id"))
    n = o.groupBy("attempt_id").agg((F.count("*") - 1).alias("replays"))
    return W.first_by(o, "attempt_id", "row_id").select("attempt_id", "row_id").join(n, "attempt_id")


@query("w5_zero_streak", f"with {STEPS}, i as (select *, sum(case when zero = 1.0 then 0 else 1 end) over (partition by user_id order by step) as g from steps), k as (select *, sum((zero = 1.0)::int) over (partition by user_id, g order by step) as streak from i) select user_id, min(step) as stop_step from k where streak >= 3 group by user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    x = W.streaks(steps(s, d), "user_id", "step", F.col("zero") == 1)
    return x.where("streak >= 3").groupBy("user_id").agg(F.min("step").cast("long").alias("stop_step"))


@query("w6_two_windows", f"with {STEPS}, " + """b as (select user_id, 'informative' as rule, (step - 1) // 32 as block, avg(1 - zero) as m from steps group by all having count(*) = 32 union all
select user_id, 'truncated', (step - 1) // 8, avg(clipped) from steps group by all having count(*) = 8), l as (select *, lag(m) over (partition by user_id, rule order by block) as p from b)
select user_id, rule, block, m as mean from l where case when rule = 'informative' then m < 0.60 and p < 0.60 else m > 0.05 and p > 0.05 end""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = steps(s, d)
    informative = W.fixed_windows(x, "user_id", "step", 1 - F.col("zero"), 32).where("mean < 0.60 and before < 0.60").withColumn("rule", F.lit("informative"))
    truncated = W.fixed_windows(x, "user_id", "step", F.col("clipped"), 8).where("mean > 0.05 and before > 0.05").withColumn("rule", F.lit("truncated"))
    return informative.union(truncated).select("user_id", "rule", "block", "mean")


@query("w7_cumulative_caps", f"with {STEPS}, c as (select *, sum(value) over (partition by user_id order by step rows unbounded preceding) as t from steps) select user_id, min(step) as stop_step from c where t >= 500 group by user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return W.crossing(steps(s, d), "user_id", "step", "value", 500.0).select("user_id", F.col("stop_step").cast("long").alias("stop_step"))


@query("w8_token_budget", "with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as running from conversations), c as (select *, min(turn) filter (running > 600) over (partition by conv_id) as cut from r) select conv_id, turn, running::bigint as running from c where cut is null or turn < cut")
def _(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("len"))
    return W.budget_cut(c, "conv_id", "turn", "len", 600, strict=True).select("conv_id", "turn", "running")


@query("w9_carried_sections", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as nth from documents) select doc_id, nth as position, last_value(case when length(line) < 20 then line end ignore nulls) over (partition by doc_id order by nth rows unbounded preceding) as section from l")
def _(s: SparkSession, d: str) -> DataFrame:
    x = W.carried(table(s, d, "documents").select("doc_id", "text"), "text", lambda line: F.char_length(line) < 20)
    return x.select("doc_id", F.col("at").cast("long").alias("position"), "section")


@query("w10_commands_left", "select l_orderkey, count(*) as used, greatest(count(*) - 5, 0) as refused, least(count(*), 5) as ran from lineitem group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return W.limited(table(s, d, "lineitem"), "l_orderkey", 5)


@query("k1_hash_order", f"select o_orderkey from (select o_orderkey, {H(chr(39) + 'k:' + chr(39) + ' || o_orderkey')} as h from orders) order by h, o_orderkey limit 100 offset 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return S.hash_order(table(s, d, "orders"), "o_orderkey", "k", 100, 20).select("o_orderkey")


@query("k2_stratified_quota", f"with q as (select source, row_number() over (order by source) % 4 + 1 as quota from (select distinct source from documents)), r as (select source, doc_id, row_number() over (partition by source order by {H(chr(39) + 'k2:' + chr(39) + ' || doc_id')}, doc_id) as rn from documents) select source, doc_id, rn from r join q using (source) where rn <= quota")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    quota = docs.select("source").distinct().withColumn("quota", F.row_number().over(Window.orderBy("source")) % 4 + 1)  # one row for each source
    most = quota.agg(F.max("quota")).first()[0] or 0  # known before the ranks, so that tasks keep so many rows of a source
    r = docs.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(h12("k2", F.col("doc_id")), "doc_id")).alias("rn")).where(F.col("rn") <= most)
    return r.withColumn("rn", F.col("rn").cast("long")).join(quota, "source").where("rn <= quota").select("source", "doc_id", "rn")


@query("k3_halving", T + ", one as (select task_id, avg(reward_p) as s1, sum(tokens) as k, avg(reward_r) as s2 from trials group by task_id), top as (select * from one order by s1 desc, k, task_id limit 2) select task_id, s1 as stage_1, s2 as stage_2 from top order by s2 desc, k, task_id limit 1")
def _(s: SparkSession, d: str) -> DataFrame:
    one = trials(s, d).groupBy("task_id").agg(F.avg("reward_p").alias("stage_1"), F.sum("tokens").alias("k"), F.avg("reward_r").alias("stage_2"))
    top = one.orderBy(F.desc("stage_1"), "k", "task_id").limit(2)
    return top.orderBy(F.desc("stage_2"), "k", "task_id").limit(1).drop("k")


@query("k4_checkpoint_choice", T + ", m as (select day, avg(reward_p) as score from trials group by day) select day as chosen, score from m order by score desc, day limit 1")
def _(s: SparkSession, d: str) -> DataFrame:
    m = trials(s, d).groupBy("day").agg(F.avg("reward_p").alias("score"))
    return m.agg(F.min_by(F.struct("day", "score"), F.struct(-F.col("score"), "day")).alias("c")).select(F.col("c.day").alias("chosen"), "c.score")


@query("k5_first_two_passes", T + ", r as (select *, row_number() over (partition by task_id order by row_id) as i from trials where success_p) select task_id, row_id from r where i <= 2 and n_calls < 7")
def _(s: SparkSession, d: str) -> DataFrame:
    e = trials(s, d).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "success_p", "n_calls"))).alias("e"))  # the trials of one task
    two = e.select("task_id", F.explode(F.slice(F.filter("e", lambda x: x["success_p"]), 1, 2)).alias("x"))
    return two.where("x.n_calls < 7").select("task_id", "x.row_id")  # how it ended counts only after the cap


@query("k6_shortest_success", "select conv_id % 50 as task_id, count(*) as rollouts, arg_min(conv_id, (n, conv_id)) as shortest from (select conv_id, count(*) as n from conversations group by conv_id) group by 1")
def _(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.groupBy((F.col("conv_id") % 50).alias("task_id")).agg(F.count("*").alias("rollouts"), F.min_by("conv_id", F.struct("n", "conv_id")).alias("shortest"))


@query("k7_largest_groups", "select sha256(text) as h, count(*) as n from documents group by 1 order by n desc, h limit 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(5)


@query("k8_locality_order", f"select o_custkey, o_orderkey, row_number() over (order by o_custkey, h, o_orderkey) as at from (select *, {H(chr(39) + 'k8:' + chr(39) + ' || o_orderkey')} as h from orders order by h, o_orderkey limit 200)")
def _(s: SparkSession, d: str) -> DataFrame:
    x = S.hash_order(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", "k8", 200)
    return x.select("o_custkey", "o_orderkey", F.row_number().over(Window.orderBy("o_custkey", "h", "o_orderkey")).cast("long").alias("at"))  # 200 rows


@query("k9_first_usable", f"select doc_id from (select doc_id, {H(chr(39) + 'k9:' + chr(39) + ' || doc_id')} as h from documents join labels using (doc_id) where quality = 1) order by h, doc_id limit 40")
def _(s: SparkSession, d: str) -> DataFrame:
    usable = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    return S.hash_order(usable, "doc_id", "k9", 40).select("doc_id")


@query("u1_union_rounds", T + "select row_id, 1 as round from trials where success_p and row_id % 2 = 0 union all select row_id, 2 from trials where success_r and row_id % 2 = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    t = trials(s, d)
    return t.where("success_p and row_id % 2 = 0").select("row_id", F.lit(1).alias("round")).unionByName(t.where("success_r and row_id % 2 = 1").select("row_id", F.lit(2).alias("round")))


@query("u2_banned_sets", "with s as (select l_orderkey, list_distinct(list(l_returnflag || l_linestatus)) as p from lineitem group by 1) select l_orderkey, len(list_intersect(p, ['RF', 'AF'])) as banned, array_to_string(list_sort(list_filter(p, lambda x: x not in ('RF', 'AF'))), ',') as others from s where list_has_any(p, ['RF', 'AF'])")
def _(s: SparkSession, d: str) -> DataFrame:
    banned = F.array(F.lit("RF"), F.lit("AF"))
    p = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("p")).where(F.arrays_overlap("p", banned))
    return p.select("l_orderkey", F.size(F.array_intersect("p", banned)).cast("long").alias("banned"), F.array_join(F.array_sort(F.array_except("p", banned)), ",").alias("others"))


@query("u3_symmetric_difference", "(select doc_id, 'only_labels' as side from labels where quality = 0 except select doc_id, 'only_labels' from documents where n_chars < 2000) union all (select doc_id, 'only_short' from documents where n_chars < 2000 except select doc_id, 'only_short' from labels where quality = 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "labels").where("quality = 0").select("doc_id"), table(s, d, "documents").where("n_chars < 2000").select("doc_id")
    return a.subtract(b).withColumn("side", F.lit("only_labels")).union(b.subtract(a).withColumn("side", F.lit("only_short")))


@query("u4_hash_split", f"with x as (select c_custkey, ('0x' || substr(sha256('split:' || c_custkey), 64, 1))::int as g from customer) select c_custkey, case when g < 8 then 'train' when g < 10 then 'dev' when g < 12 then 'gate' else 'test' end as split from x")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", S.hash_split(F.col("c_custkey"), "split").alias("split"))


@query("u5_hash_halves", f"select c_custkey, {H(chr(39) + 'u5:' + chr(39) + ' || c_custkey', 8)} % 2 as low_bit, row_number() over (partition by c_nationkey order by sha256('u5:' || c_custkey), c_custkey) <= count(*) over (partition by c_nationkey) / 2 as first_half from customer")
def _(s: SparkSession, d: str) -> DataFrame:
    from trialspark.functions.columns import hex_int

    c = table(s, d, "customer").select("c_custkey", "c_nationkey", hash_of("u5", F.col("c_custkey")).alias("h"))
    halves = c.groupBy("c_nationkey").agg(F.floor(F.count("*") / 2).alias("k"))
    return S.within(c, "c_nationkey", "h", "c_custkey", halves).select("c_custkey", (hex_int(F.col("h"), 8) % 2).alias("low_bit"), F.col("within").alias("first_half"))


@query("u6_group_roles", "with g as (select o_custkey % 400 as g, bool_or(o_totalprice > 490000) as exposed from orders group by 1), r as (select g, exposed, row_number() over (partition by exposed order by sha256('u6:' || g), g) as nth from g) select g, exposed, case when exposed then 'train' when nth <= 48 then 'test' when nth <= 64 then 'gate' when nth <= 80 then 'checkpoint' when nth <= 96 then 'search' else 'train' end as role from r")
def _(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "orders").groupBy((F.col("o_custkey") % 400).alias("g")).agg(F.bool_or(F.col("o_totalprice") > 490000).alias("exposed"))
    g = g.withColumn("h", hash_of("u6", F.col("g")))
    return S.roles(g, "g", "exposed", "h", {"test": 48, "gate": 16, "checkpoint": 16, "search": 16}, "train", 144).drop("h")


@query("u7_treatment", f"select o_orderkey, ({H(chr(39) + 'u7:' + chr(39) + ' || o_orderkey')} % 1000000) / 1e6 < 0.3 as treated, {H(chr(39) + 'fam:' + chr(39) + ' || o_orderkey')} % 5 as family from orders")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    fam = S.picked(F.array(*(F.lit(i).cast("long") for i in range(5))), "fam", k)
    return table(s, d, "orders").select("o_orderkey", S.treated(k, "u7", 0.3).alias("treated"), fam.alias("family"))


@query("u8_fixed_pick", f"with c as (select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as l from orders group by 1) select o_custkey, l[{H(chr(39) + 'u8:' + chr(39) + ' || o_custkey')} % len(l) + 1] as pick from c")
def _(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l"))
    return c.select("o_custkey", S.picked(F.col("l"), "u8", F.col("o_custkey")).alias("pick"))


@query("u9_root_collapse", "select count(*) as records, count(distinct regexp_replace(url, '[?#].*$', '')) as roots, count(distinct url) as urls from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").agg(F.count("*").alias("records"), F.count_distinct(F.regexp_replace("url", "[?#].*$", "")).alias("roots"), F.count_distinct("url").alias("urls"))
