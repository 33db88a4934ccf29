"""Facts of Python sources out of their syntax trees: assertions, tests, imports, string constants, expected values."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENCE = r"\.exists\(|\.is_file\(|\.is_dir\(|os\.path\.(?:exists|isfile|isdir)"
SKIP = r"pytest\.(?:skip|xfail)"
#: White space and line ends as Python's str.strip and str.splitlines have them.
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


class _Facts(ast.NodeVisitor):
    """Rows (kind, name, line, value) of one tree, each node seen once."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str | None, int, str | None]] = []

    def visit_Assert(self, node: ast.Assert) -> None:  # noqa: N802
        self.rows.append(("assert", None, node.lineno, ast.unparse(node.test)))
        self.generic_visit(node)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.rows.append(("function", node.name, node.lineno, None))
        self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function  # noqa: N815

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        self.rows += (("import", a.name, node.lineno, None) for a in node.names)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        self.rows.append(("import", node.module or "", node.lineno, None))

    def visit_Constant(self, node: ast.Constant) -> None:  # noqa: N802
        if isinstance(node.value, str):
            self.rows.append(("string", None, node.lineno, node.value))

    def _assigned(self, node: ast.Assign | ast.AnnAssign) -> None:
        value = _written_out(node.value)
        if value is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                self.rows.append(("value", ast.unparse(target), node.lineno, value))
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = _assigned  # noqa: N815


def _written_out(node: ast.expr | None) -> str | None:
    """The text of a literal: a string, bytes, or a list of strings as lines; None for anything else."""
    try:
        value = ast.literal_eval(node) if node is not None else None
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return "\n".join(value)
    return value.decode(errors="replace") if isinstance(value, bytes) else value if isinstance(value, str) else None


def _whole(text: str | None) -> str | None:
    """Half surrogates, which a literal may spell and a column cannot hold, as question marks."""
    return None if text is None else text.encode("utf-8", "replace").decode()


def _facts_of(source: str | None) -> list[tuple[str, str | None, int, str | None]]:
    facts = _Facts()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            facts.visit(ast.parse(source or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("error", None, 0, None)]
    return facts.rows


# Table functions of sources go without Arrow: a task then holds some hundred sources at once, not 10,000 with all that they give.
@F.udtf(returnType="kind string, name string, line int, value string", useArrow=False)
class SourceFacts:
    """kind, name, line, value of a Python source: assert (its test), function, import (module), string (each constant, those within
    f-strings too), value (of each target that a literal is assigned to), or one row error if it does not parse."""

    def eval(self, source: str | None) -> Iterator[tuple[str, str | None, int, str | None]]:
        for kind, name, line, value in _facts_of(source):
            yield kind, _whole(name), line, _whole(value)


def source_facts(sources: DataFrame, text: str) -> DataFrame:
    """source, kind, name, line, value: the facts of each different source, parsed once; source is its SHA-256 (null is an empty
    source). Join them by digest_of(text)."""
    different = sources.select(F.coalesce(text, F.lit("")).alias("text")).distinct()
    return different.lateralJoin(SourceFacts(F.col("text").outer())).select(F.sha2("text", 256).alias("source"), "kind", "name", "line", "value")


def digest_of(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def with_features(df: DataFrame, text: str) -> DataFrame:
    """df with features, a struct about the Python source in column text: syntax_error, assertions, test_functions, imports (first
    parts of module names, sorted), presence_only (there are assertions, and all only ask whether a file is there), skip_or_xfail.
    A source that does not parse has none of the others; null is an empty source."""
    kind, is_ = F.col("kind"), lambda k: F.col("kind") == k
    facts = source_facts(df, text).groupBy("source").agg(
        F.bool_or(is_("error")).alias("syntax_error"), F.count_if(is_("assert")).alias("assertions"), F.count_if(is_("function") & F.col("name").startswith("test")).alias("test_functions"),
        F.array_sort(F.collect_set(F.when(is_("import"), F.substring_index("name", ".", 1)))).alias("imports"), F.coalesce(F.bool_and(F.when(kind == "assert", F.col("value").rlike(PRESENCE))), F.lit(False)).alias("presence_only"),
    )
    joined = df.withColumn("_source", digest_of(text)).join(facts.withColumnRenamed("source", "_source"), "_source", "left")
    none, error = F.lit(0).cast("long"), F.coalesce("syntax_error", F.lit(False))
    features = F.struct(
        error.alias("syntax_error"), F.coalesce("assertions", none).alias("assertions"), F.coalesce("test_functions", none).alias("test_functions"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"),
        F.coalesce("presence_only", F.lit(False)).alias("presence_only"), (~error & F.coalesce(F.col(text).rlike(SKIP), F.lit(False))).alias("skip_or_xfail"),
    )
    return joined.select(*df.columns, features.alias("features"))


@F.udtf(returnType="line string", useArrow=False)
class LiteralLines:
    """The different lines of a source's string constants, without white space at their ends, that are worth a search: 18 characters or
    more with four letters in a row, but no paths and addresses."""

    def eval(self, source: str | None) -> Iterator[tuple[str]]:
        strings = (value for kind, _, _, value in _facts_of(source) if kind == "string")
        for line in sorted({line.strip() for value in strings for line in value.splitlines()}):
            if len(line) >= 18 and re.search("[A-Za-z]{4}", line) and not line.startswith(("/", "http")):
                yield (_whole(line),)


def literal_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line): for each row the lines (see LiteralLines) of the Python source in column text, each once. Comments and code are none;
    a source that does not parse has none. Each source is parsed where it is read, nothing is shuffled."""
    return df.select(key, F.col(text).alias("_source")).lateralJoin(LiteralLines(F.col("_source").outer())).select(key, "line")


@F.udtf(returnType="name string, value string", useArrow=False)
class ExpectedValues:
    """name, value of each target with "expected" in its name that a source assigns a literal to."""

    def eval(self, source: str | None) -> Iterator[tuple[str | None, str | None]]:
        for kind, name, _, value in _facts_of(source):
            if kind == "value" and "expected" in name.lower():
                yield _whole(name), _whole(value)


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends, as Python's split has them."""
    return F.regexp_replace(F.regexp_replace(text, EDGE, ""), BLANKS, " ")


def expected_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, variable, block): values of 40 characters and two lines or more that a Python source assigns to a name with "expected" in
    it: strings, bytes, or lists of strings; the block has its white space squeezed."""
    values = df.select(key, F.col(text).alias("_source")).lateralJoin(ExpectedValues(F.col("_source").outer())).where(F.char_length("value") >= 40)
    values = values.where(F.regexp_replace("value", EDGE, "").rlike(LINE_END))
    return values.select(key, F.col("name").alias("variable"), squeezed(F.col("value")).alias("block"))
