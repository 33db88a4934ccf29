"""Queries over text screens and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.operators import code as C
from trialspark.operators import text as X
from trialspark.operators.components import connected_components
from trialspark.operators.edits import character_similarity
from trialspark.plans.views import table
from trialspark.shared import materialise

Q: dict = {}
O: dict[str, str] = {}
B = "[ \t\r\n]+"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


# RE2 has no look-behind: the character before a path is matched and put back.
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(lower(url || ' ' || html), 'task_[0-9]+_[a-f0-9]+', 'TASK', 'g'), '(^|[^\p{L}\p{M}\p{N}_])/(?:[\p{L}\p{M}\p{N}_.~-]+/)*[\p{L}\p{M}\p{N}_.~-]+', '\1/PATH', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', 'NUM', 'g')"


NORMAL_DOCS = NORMAL.replace("url || ' ' || html", "text")


@query("t1_normalise", f"select doc_id, sha256(trim(regexp_replace({NORMAL_DOCS}, '\\s+', ' ', 'g'), ' ')) as digest from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.sha2(X.normalise(F.col("text")), 256).alias("digest"))


@query("t1_normalise_paths", f"select page_id, trim(regexp_replace({NORMAL}, '\\s+', ' ', 'g'), ' ') as normal from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", X.normalise(F.concat("url", F.lit(" "), "html")).alias("normal"))


@query("t2_text_hashes", "select doc_id, substr(sha256(text), 1, 16) as exact, substr(sha256(lower(text)), 1, 16) as folded from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("exact"), F.substring(F.sha2(F.lower("text"), 256), 1, 16).alias("folded"))


PLAIN = {"email": "@[a-z0-9]+[.]example", "token": "token = ", "licence": "(?i)licensed under", "digits": "[0-9]{16}", "junk": "[%$&#*]{3}"}


def _flag_list(patterns: dict[str, str], text: str = "text") -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, '{p}') then '{n}' end" for n, p in patterns.items()) + "], lambda x: x is not null)"


@query("t4_topic_booleans", "select page_id, regexp_matches(html, '(?i)<table') as tabular, regexp_matches(html, '(?i)<script') as scripted, regexp_matches(url, '/(en|fr)/') as western from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.col("html").rlike("(?i)<table").alias("tabular"), F.col("html").rlike("(?i)<script").alias("scripted"), F.col("url").rlike("/(en|fr)/").alias("western"))


@query("t6_corpus_flag_counts", f"select flag, count(*) as n from (select unnest({_flag_list(PLAIN)}) as flag from documents) group by flag")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.explode(X.flags(F.col("text"), PLAIN)).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


NET = {k: X.SCREENS[k] for k in ("network", "heavy_or_service", "command_limit", "privilege")}


@query("t7_installer_flags", f"select role, count(*) as n, {', '.join(f'count_if(regexp_matches(text, {chr(39)}{p}{chr(39)})) as {k}' for k, p in NET.items())} from conversations group by role")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), *(F.count_if(F.col("text").rlike(X.ascii_words(p))).alias(k) for k, p in NET.items()))


@query("t8_code_execution", f"select page_id, regexp_matches(html, '{X.SCREENS['code_execution']}') as executes from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.col("html").rlike(X.SCREENS["code_execution"]).alias("executes"))


DOCKER = r"""select p_partkey, 'FROM img' || p_size || E'\nRUN apt-get update && apt install -y lib' || p_partkey % 7 || E' \\\n    tool' || p_partkey % 5 || E' \\\n  --no-install-recommends && true; apt-get  install zlib lib' || p_partkey % 7 || E'\n  WORKDIR /a\n'
  || case when p_partkey % 2 = 0 then E'\tWORKDIR  /b' || p_partkey || E'\n\tUSER u\n' else '' end || 'RUN make ' || p_name || E'\n'
  || case p_partkey % 4 when 0 then E'ENTRYPOINT ["serve", "-p", "' || p_name || E'"]\nCMD ["x"]\n' when 1 then E'CMD ["/bin/sh"]\n' when 2 then E'CMD run it\nCMD tail -f /dev/null\n' else '' end as text from part"""


@query("t9_dockerfile_fields", rf"""with f as ({DOCKER}) select p_partkey, coalesce(regexp_extract_all(text, '(?m)^\s*WORKDIR\s+(\S+)', 1)[-1], '/') as workdir, regexp_extract_all(text, '(?m)^\s*USER\s+(\S+)', 1)[-1] as "user", array_to_string(regexp_extract_all(text, '(?m)^FROM\s+(\S+)', 1), ',') as images,
'lib' || p_partkey % 7 || ',tool' || p_partkey % 5 || ',zlib' as packages, len(regexp_extract_all(text, '(?m)^RUN')) as runs, case when p_partkey % 4 = 0 then 'serve -p ' || chr(39) || p_name || chr(39) || ' x' end as service from f join part using (p_partkey)""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Dockerfiles with indented directives, install lists over several lines, services, shells and keep-alives."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("FROM img"), "p_size", F.lit("\nRUN apt-get update && apt install -y lib"), k % 7, F.lit(" \\\n    tool"), k % 5, F.lit(" \\\n  --no-install-recommends && true; apt-get  install zlib lib"), k % 7, F.lit("\n  WORKDIR /a\n"),
        F.when(k % 2 == 0, F.concat(F.lit("\tWORKDIR  /b"), k, F.lit("\n\tUSER u\n"))).otherwise(""), F.lit("RUN make "), "p_name", F.lit("\n"),
        F.when(k % 4 == 0, F.concat(F.lit('ENTRYPOINT ["serve", "-p", "'), "p_name", F.lit('"]\nCMD ["x"]\n'))).when(k % 4 == 1, 'CMD ["/bin/sh"]\n').when(k % 4 == 2, "CMD run it\nCMD tail -f /dev/null\n").otherwise(""),
    )
    f = X.dockerfile(F.col("text"))
    fields = {n: F.array_join(f[n], ",") if n in ("images", "packages") else f[n] for n in f}
    return table(s, d, "part").select("p_partkey", text.alias("text")).select("p_partkey", *(c.alias(n) for n, c in fields.items()))


#: Made-up task files, by doc_id, as the given tables hold none: verifiers, and Dockerfiles.
MADE = """files as (select doc_id, text as instruction, 'import os' || chr(10) || case when doc_id % 4 = 0 then 'import numpy.linalg' || chr(10) else '' end || 'def test_a():' || chr(10) || '    assert os.path.exists("x")' || chr(10) ||
  case doc_id % 5 when 0 then '    assert 1 == 1' || chr(10) when 1 then '    assert os.path.isfile("y")' || chr(10) when 2 then '  broken(' else '' end || case when doc_id % 9 = 0 then 'pytest.skip' || chr(10) else '' end as test,
  case when doc_id % 3 = 0 then 'FROM ubuntu:22.04' else 'FROM debian' end || chr(10) || case doc_id % 6 when 0 then 'COPY . /app' when 1 then 'ADD truth/x /y' when 2 then 'RUN cat /data/answer_1.json' else 'RUN true' end as dockerfile from documents)"""


def made_files(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda n, options, rest: F.coalesce(*(F.when(k % n == i, F.lit(x)) for i, x in options.items()), F.lit(rest))
    test = F.concat(
        F.lit("import os\n"), pick(4, {0: "import numpy.linalg\n"}, ""), F.lit('def test_a():\n    assert os.path.exists("x")\n'),
        pick(5, {0: "    assert 1 == 1\n", 1: '    assert os.path.isfile("y")\n', 2: "  broken("}, ""), pick(9, {0: "pytest.skip\n"}, ""),
    )
    dockerfile = F.concat(pick(3, {0: "FROM ubuntu:22.04"}, "FROM debian"), F.lit("\n"), pick(6, {0: "COPY . /app", 1: "ADD truth/x /y", 2: "RUN cat /data/answer_1.json"}, "RUN true"))
    return docs(s, d).select("doc_id", F.col("text").alias("instruction"), test.alias("test"), dockerfile.alias("dockerfile"))


FEATURES = """, features as (select *, doc_id % 5 = 2 as syntax_error, case doc_id % 5 when 2 then 0 when 0 then 2 when 1 then 2 else 1 end as assertions, (doc_id % 5 <> 2)::bigint as test_functions,
  case when doc_id % 5 = 2 then '' when doc_id % 4 = 0 then 'numpy,os' else 'os' end as imports, doc_id % 5 not in (0, 2) as presence_only, doc_id % 5 <> 2 and doc_id % 9 = 0 as skip_or_xfail from files)"""


@query("t10_python_features", f"with {MADE}{FEATURES} select doc_id::varchar as id, syntax_error, assertions, test_functions, imports, presence_only, skip_or_xfail from features")
def _(s: SparkSession, d: str) -> DataFrame:
    f = C.with_features(made_files(s, d).select(F.col("doc_id").cast("string").alias("id"), "test"), "test").select("id", "features.*")
    return f.withColumn("imports", F.array_join("imports", ","))


def _flag(name: str, rule: str) -> str:
    return f"case when {rule} then '{name}' end"


def _like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


TASK_RULES = ", ".join((
    _flag("runtime_network_text", _like("instruction || chr(10) || test", X.TASK_NETWORK)), _flag("service_or_heavy_text", _like("instruction || chr(10) || test", X.TASK_HEAVY)), _flag("multimedia_text", _like("instruction", X.TASK_MEDIA)),
    _flag("weak_verifier_static", "syntax_error or assertions < 2 or test_functions = 0 or presence_only or skip_or_xfail"), _flag("answer_file_suspect", _like("dockerfile", X.ANSWER_COPIED) + " or " + _like("dockerfile", X.ANSWER_FILE)),
    _flag("copy_entire_context", _like("dockerfile", X.WHOLE_CONTEXT)), _flag("nonstdlib_test_import", "contains(imports, 'numpy')"), _flag("other_base", "doc_id % 3 <> 0"), _flag("command_count_constraint", _like("instruction", X.COMMAND_LIMIT)),
))


@query("t3_task_flags", f"with {MADE}{FEATURES} select doc_id, array_to_string(list_filter([{TASK_RULES}], lambda x: x is not null), ',') as flags from features")
def _(s: SparkSession, d: str) -> DataFrame:
    """The documents' texts as instructions, with made-up verifiers and Dockerfiles."""
    f = C.with_features(made_files(s, d), "test")
    return f.select("doc_id", F.array_join(X.task_flags(F.col("instruction"), F.col("test"), F.col("dockerfile"), F.col("features")), ",").alias("flags"))


def _sql_hits(name: str) -> str:
    text, found = ("lower(text)" if name == "trace" else "text"), "x"
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{X.HITS[name]}'), lambda x: {'substr(x, 1, 40)' if name == 'danger' else found}))), ',') as {name}"


@query("t5_screen_hits", f"select doc_id, {', '.join(map(_sql_hits, X.HITS))} from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", *(F.array_join(v, ",").alias(k) for k, v in X.screen_hits(F.col("text")).items()))


def as_python(text: F.Column) -> F.Column:
    """The text as a list with one string constant in Python."""
    return F.to_json(F.array(text))


Q["t5_regex_hits"], O["t5_regex_hits"] = Q["t5_screen_hits"], O["t5_screen_hits"]
Q["t3_static_flags"], O["t3_static_flags"] = Q["t3_task_flags"], O["t3_task_flags"]


@query("t11_literal_lines", """with l as (select doc_id, trim(unnest(string_split(text, chr(10))), chr(9) || chr(10) || chr(13) || ' ') as line from documents where doc_id % 7 <> 0
  union all select doc_id, unnest(['the answer of task', 'names of a docstring line']) from documents where doc_id % 7 <> 0)
select distinct doc_id, sha256(line) as line from l where length(line) >= 18 and regexp_matches(line, '[A-Za-z]{4}') and not starts_with(line, '/') and not starts_with(line, 'http')""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Verifiers with the documents' lines in a constant, besides comments, code, a docstring, a path and a formatted string; one in
    seven does not parse."""
    k = F.col("doc_id").cast("string")
    test = F.concat(
        F.lit("import os  # a comment that is no literal of the test\nWANTED = "), as_python(F.col("text")), F.lit('\ndef test_a():\n    """Short.\n      names of a docstring line  \n    """\n    assert os.path.exists("/home/user/of/a/longer/path")\n    assert run() == f"the answer of task {'), k,
        F.lit('} is so"\n'), F.when(F.col("doc_id") % 7 == 0, "  broken(").otherwise(""),
    )
    return C.literal_lines(docs(s, d).select("doc_id", test.alias("test")), "doc_id", "test").select("doc_id", F.sha2("line", 256).alias("line"))


TFIDF = """with t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t from documents),
g as (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as gram from t), tf as (select doc_id, gram, count(*) as tf from g group by all),
n as (select count(*) as n from documents), f as (select gram, count(*) as df from tf group by gram having count(*) >= 2 and count(*) <= 0.95 * (select n from n)),
w as (select doc_id, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join f using (gram), n), v as (select doc_id, gram, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w),
r as (select doc_id, min(doc_id) over (partition by text) as rep from documents), vr as (select * from v where doc_id in (select rep from r)),
pairs as (select x.doc_id as a, y.doc_id as b, sum(x.w * y.w) as cosine from vr x join vr y on x.gram = y.gram and x.doc_id < y.doc_id group by all having sum(x.w * y.w) >= 0.5)"""


def pairs_of(s: SparkSession, d: str, threshold: float = 0.5) -> DataFrame:
    """Pairs of different texts; weights come from all documents, copies are then left to their first (see links_of)."""
    return X.similar_texts(docs(s, d), "doc_id", "text", threshold)


def links_of(s: SparkSession, d: str) -> DataFrame:
    """(a, b): every document that is not the first of its exact text, after the first; what pairs_of leaves out."""
    return X.classes_of(docs(s, d), "doc_id", "text").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))


def pairs_and_links(s: SparkSession, d: str) -> DataFrame:
    return pairs_of(s, d).union(links_of(s, d).withColumn("cosine", F.lit(1.0)))


COPIES = ", m as (select doc_id, min(doc_id) over (partition by text) as rep from documents where text is not null)"


@query("t12_tfidf_pairs", TFIDF + " select a, b, round(cosine, 6) as cosine from pairs")
def _(s: SparkSession, d: str) -> DataFrame:
    return pairs_of(s, d).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("t12_exact_classes", f"with x as (select 1){COPIES} select doc_id, rep, count(*) over (partition by rep) as members from m")
def _(s: SparkSession, d: str) -> DataFrame:
    m = X.classes_of(docs(s, d), "doc_id", "text")
    return m.join(m.groupBy("rep").agg(F.count("*").alias("members")), "rep").select("doc_id", "rep", "members")


@query("t13_components_with_copies", TFIDF.replace("with t as", "with recursive t as") + COPIES + ", l as (select a, b from pairs union select rep, doc_id from m where doc_id <> rep), e as (select a, b from l union select b, a from l), c as (select a as node, a as root from e union select e.b, c.root from c join e on e.a = c.node where c.root < e.b) select node, min(root) as component from c group by node")
def _(s: SparkSession, d: str) -> DataFrame:
    return connected_components(pairs_and_links(s, d).select(F.col("a").alias("u"), F.col("b").alias("v")))


Q["t13_components"], O["t13_components"] = Q["t13_components_with_copies"], O["t13_components_with_copies"]


@query("t14_threshold_sensitivity", TFIDF.replace("with t as", "with recursive t as") + COPIES + """, l as (select a, b, cosine from pairs union all select rep, doc_id, 1.0 from m where doc_id <> rep), k as (select unnest([0.5, 0.6, 0.7, 0.8])::double as threshold),
e as (select threshold, a, b from k, l where cosine >= threshold union select threshold, b, a from k, l where cosine >= threshold), c as (select threshold, a as node, a as root from e union select e.threshold, e.b, c.root from c join e on e.a = c.node and e.threshold = c.threshold where c.root < e.b),
roots as (select threshold, node, min(root) as root from c group by all), z as (select threshold, root, count(*) as n from roots group by all) select threshold, count(*) as groups, max(n) as largest, sum(n)::bigint as members from z group by threshold""")
def _(s: SparkSession, d: str) -> DataFrame:
    return X.groups_at(materialise(pairs_and_links(s, d), "pairs"), [0.5, 0.6, 0.7, 0.8])


def _by_side(threshold: float) -> str:
    return TFIDF.replace(">= 0.5", f">= {threshold}") + COPIES + ", every as (select x.doc_id as a, y.doc_id as b from pairs join m x on x.rep = pairs.a join m y on y.rep = pairs.b union all select x.doc_id, y.doc_id from m x join m y on x.rep = y.rep and x.doc_id < y.doc_id) select case when a % 4 = 0 and b % 4 = 0 then 'within_known' when a % 4 = 0 or b % 4 = 0 then 'across' else 'within_candidates' end as side, count(*) as pairs from every group by 1"


def by_side(s: SparkSession, d: str, threshold: float) -> DataFrame:
    return X.pairs_by_side(pairs_of(s, d, threshold), X.classes_of(docs(s, d), "doc_id", "text"), F.col("doc_id") % 4 == 0)


@query("t15_cross_corpus_pairs", _by_side(0.5))
def _(s: SparkSession, d: str) -> DataFrame:
    return by_side(s, d, 0.5)


@query("t15_cross_corpus_documents", _by_side(0.3))
def _(s: SparkSession, d: str) -> DataFrame:
    return by_side(s, d, 0.3)


@query("t16_without_comments", f"select page_id, sha256(trim(regexp_replace(lower(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')), '{B}', ' ', 'g'), ' ')) as digest from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.sha2(X.plain(F.col("html")), 256).alias("digest"))


EDITS = [("[A-Za-z0-9.]+@[a-z0-9.]+", "<address>"), ("token = \"[0-9a-f]+\"", "token = <key>"), ("[0-9]{16}", "<number>")]


@query("t17_redaction", "select doc_id, sha256(t) as digest, regexp_matches(t, '@mail') as leaks from (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9.]+@[a-z0-9.]+', '<address>', 'g'), 'token = \"[0-9a-f]+\"', 'token = <key>', 'g'), '[0-9]{16}', '<number>', 'g') as t from documents)")
def _(s: SparkSession, d: str) -> DataFrame:
    nested = docs(s, d).select("doc_id", F.struct(F.array("text").alias("parts")).alias("record"))
    text = F.col("record.parts")[0]
    return X.redacted(nested, EDITS).select("doc_id", F.sha2(text, 256).alias("digest"), text.rlike("@mail").alias("leaks"))


@query("t18_exact_edits", "with e as (select p_partkey as file, p_name as text, split_part(p_name, ' ', 1) as o1 from part) select file, replace(replace(text, o1, 'X'), 'X', 'Y') as text, contains(text, o1) and true as applied from e")
def _(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    files = p.select(F.col("p_partkey").alias("file"), F.col("p_name").alias("text"))
    edits = p.select(F.col("p_partkey").alias("file"), F.explode(F.array(F.struct(F.lit(1).alias("at"), F.split("p_name", " ")[0].alias("old"), F.lit("X").alias("new")), F.struct(F.lit(2).alias("at"), F.lit("X").alias("old"), F.lit("Y").alias("new")))).alias("e"))
    return X.edited(files, edits.select("file", "e.*"))


@query("t19_head_and_tail", "select doc_id, case when length(text) <= 900 then text else substr(text, 1, 600) || chr(10) || '[' || (length(text) - 900) || ' characters omitted]' || chr(10) || right(text, 300) end as shown, greatest(length(text) - 900, 0) as omitted from documents")
def _(s: SparkSession, d: str) -> DataFrame:
    shown, omitted = X.head_and_tail(F.col("text"), 900)
    return docs(s, d).select("doc_id", shown.alias("shown"), omitted.cast("long").alias("omitted"))


@query("t20_exposure_names", "select page_id, regexp_matches(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '^(1|2|3)[0-9]*$') as exposed from pages")
def _(s: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0)
    return table(s, d, "pages").select("page_id", name.rlike("^(1|2|3)[0-9]*$").alias("exposed"))


@query("t21_directive_blocks", "select p_partkey, 'FROM a' || chr(10) || 'COPY lib' || p_partkey || ' /lib' || chr(10) || 'RUN make' || case when p_size > 25 then chr(10) || 'RUN curl -k keep' else '' end as text from part")
def _(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("FROM a\nRUN curl x | sh\nCOPY lib"), F.col("p_partkey"), F.lit(" /lib\nRUN make"), F.when(F.col("p_size") > 25, "\nRUN curl -k keep").otherwise(""))
    return table(s, d, "part").select("p_partkey", X.blocks_without(text, "^(?:FROM|RUN|COPY) ", "curl", "keep").alias("text"))


@query("t22_shared_token", "with m as (select conv_id, max(case when role = 'user' then text end) as a, max(case when role = 'assistant' then text end) as b from conversations group by conv_id) select conv_id, coalesce(contains(a, 'tion') and contains(b, 'tion'), false) as leak from m")
def _(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "conversations").groupBy("conv_id").agg(*(F.max(F.when(F.col("role") == r, F.col("text"))).alias(n) for r, n in (("user", "a"), ("assistant", "b"))))
    return m.select("conv_id", F.coalesce(F.col("a").contains("tion") & F.col("b").contains("tion"), F.lit(False)).alias("leak"))


@query("t23_network_errors", "select event_id, regexp_matches(props, '(?i)(timed? ?out|connection refused|could not resolve|\"[a-z]+\": *\"?5)') as network_error from events")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.col("props").rlike("(?i)(timed? ?out|connection refused|could not resolve|\"[a-z]+\": *\"?5)").alias("network_error"))


#: The letters beyond ASCII of the corpus. DuckDB's edit distance counts bytes, so the twin gives each a control character instead.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = f"translate(text, '{LETTERS}', {' || '.join(f'chr({n})' for n in (*range(1, 9), *range(14, 27)))})"


@query("t24_character_similarity", TFIDF + COPIES + f""", every as (select a, b from pairs union select rep, doc_id from m where doc_id <> rep), o as (select doc_id, length(text) as n, {ONE_BYTE} as t from documents)
select a, b, round(case when x.t = y.t then 1.0 else 1 - levenshtein(x.t, y.t) / greatest(x.n, y.n, 1)::double end, 6) as similarity from every join o x on x.doc_id = a join o y on y.doc_id = b""")
def _(s: SparkSession, d: str) -> DataFrame:
    p = pairs_and_links(s, d)
    x, y = (docs(s, d).select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    parts = 32 * s.sparkContext.defaultParallelism  # distances take time, not bytes, by which small tasks would be put together
    return p.join(x, "a").repartition(parts, "b").join(y, "b").select("a", "b", F.round(character_similarity(F.col("text_a"), F.col("text_b")), 6).alias("similarity"))
