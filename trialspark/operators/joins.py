"""Joins of trial and text tables: fail-closed arms, prefixes as equi-joins, containment, ranges, overlaps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.prefilter import split_by_ids


MOST_RANGES = 10_000
#: Paths below one entry that a task of a prefix join takes, about.
HOT = 1 << 17


def arm_report(frozen: DataFrame, arm: DataFrame, key: str, stratum: str) -> DataFrame:
    """One row: how many ids the arm has twice, lacks, has beyond the frozen rows, or has with another stratum."""
    a = arm.groupBy(key).agg(F.count("*").alias("n"), F.min(stratum).alias("theirs"), F.max(stratum).alias("theirs_too"))
    f = frozen.select(key, F.col(stratum).alias("ours"), F.lit(True).alias("expected"))
    j = f.join(a, key, "full_outer")
    other = F.col("expected") & F.col("n").isNotNull() & ~(F.col("ours").eqNullSafe(F.col("theirs")) & F.col("ours").eqNullSafe(F.col("theirs_too")))
    return j.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("unexpected"), F.count_if(other).alias("mismatched"))


def ancestors(path: str | Column) -> Column:
    """The path itself and every folder above it, each with its closing slash."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.concat(F.array(p), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")))


def prefix_join(paths: DataFrame, entries: DataFrame, path: str = "path", entry: str = "entry", hot: int = HOT) -> DataFrame:
    """All columns of paths and entries where an entry is the path or, if it ends in a slash, a folder above it: an equi-join on
    the exploded ancestors instead of comparing every path with every entry.

    Ancestors that a bitmap shows to be no entry are not shuffled, so folders that all paths share cost nothing unless they are entries. An
    entry above more than hot paths is dealt by hash into parts of about so many; these entries, one for each hot rows at most, are
    broadcast. Paths are counted by folder first, so no single key is sorted in one task."""
    wanted = entries.select(entry).distinct()
    above, _ = split_by_ids(paths.withColumn(entry, F.explode(F.array_distinct(ancestors(path)))), entry, wanted)
    folder = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(F.substring_index(path, "/", -1)))
    folders = paths.groupBy(folder.alias("_folder")).agg(F.count("*").alias("_n")).select("_n", F.explode(F.array_distinct(ancestors("_folder"))).alias(entry))
    counts = split_by_ids(folders, entry, wanted)[0].groupBy(F.col(entry).alias("_entry")).agg(F.sum("_n").alias("_n")).where(F.col("_n") > hot)
    parts = F.broadcast(counts.select("_entry", F.ceil(F.col("_n") / hot).alias("_parts")))
    dealt = lambda df: df.join(parts, F.col(entry) == F.col("_entry"), "left")
    one = F.coalesce("_parts", F.lit(1).cast("long"))
    left = dealt(above).withColumn("_part", F.pmod(F.xxhash64(path), one)).drop("_entry", "_parts")
    right = dealt(entries).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("_entry", "_parts")
    return left.join(right, [entry, "_part"]).drop("_part")


def lines_in(texts: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, line) of the distinct trimmed lines of at least so many characters."""
    return texts.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim("line").alias("line")).where(F.char_length("line") >= least).distinct()


def flat(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def is_block(text: Column, least: int = 40) -> Column:
    """Whether a text has so many characters and, without the white space around it, two lines or more."""
    return (F.char_length(text) >= least) & F.btrim(text, F.lit(" \t\r\n")).rlike("[\r\n]")


def range_join(rows: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """Rows with the half-open range [lo, hi) that holds value; ranges is a list of constants, of MOST_RANGES at most."""
    if ranges.limit(MOST_RANGES + 1).count() > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges")
    return rows.join(F.broadcast(ranges), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))


def gram_hashes(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram) of the distinct n-word windows of the lower-cased text, as hashes."""
    return gram_sets(df, key, text, n).select(key, F.explode_outer("grams").alias("gram")).where("gram is not null")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once, however Spark moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _windows(hashes: Column, n: int) -> Column:
    """Hashes of all n-element windows: of two halves of equal length, until the halves of a window overlap."""
    have = 1
    while have < n:
        step = min(have, n - have)
        hashes, have = _with(hashes, _pairs_at(step)), have + step
    return hashes


def _pairs_at(step: int) -> Callable[[Column], Column]:
    def pairs(h: Column) -> Column:
        left = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))

    return pairs


def mentioned(files: DataFrame, task: str, path: str, instructions: DataFrame, text: str) -> DataFrame:
    """(task, path) of files (task, path) whose name stands in their task's instruction (task, text; one for each task) as whole
    words, or whose whole path stands in it.

    A name in the text brings its first word there as a word, a path the first word of its last folder
    (one between two slashes; other paths are held against the text). Files meet the words of
    their instruction, not the text; only names of several words and paths whose folder is named are held against it. Nulls
    match nothing; repeated files count once; words are runs of letters, digits and underscores of any script."""
    word, name, folder = r"(?U)\w+", F.regexp_extract("path", "[^/]*$", 0), F.regexp_extract("path", "/([^/]+)/[^/]*$", 1)
    rows = files.select(F.col(task).alias("task"), F.col(path).alias("path")).where("path is not null").distinct()
    rows = rows.select("task", "path", name.alias("name"), F.regexp_extract(name, word, 0).alias("of_name"), F.regexp_extract(folder, word, 0).alias("of_folder"))
    texts = instructions.select(F.col(task).alias("task"), F.col(text).alias("text"))
    words = texts.select("task", F.explode(F.array_union(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(word), 0))).alias("word"))
    named, placed = (rows.join(words.withColumnRenamed("word", c), ["task", c], "left_semi") for c in ("of_name", "of_folder"))
    whole = F.col("name") == F.col("of_name")
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    several = named.where(~whole & (F.col("name") != "")).join(texts, "task").where(F.regexp_like("text", quoted))
    paths = placed.join(texts, "task").where(F.col("text").contains(F.col("path")))
    found = [x.select("task", "path") for x in (named.where(whole & (F.col("name") != "")), several, paths)]
    return reduce(DataFrame.union, found).distinct().select(F.col("task").alias(task), F.col("path").alias(path))


def gram_sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, grams) as gram_hashes, in arrays (empty without a window): each word is hashed once, and windows from hashes."""
    words = F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda w: w != "")
    return df.select(key, F.array_distinct(_windows(F.transform(words, lambda x: F.xxhash64(x)), n)).alias("grams"))


def shared_grams(df: DataFrame, key: str, text: str, known: DataFrame, known_text: str, n: int) -> DataFrame:
    """key, grams, shared of the rows that share an n-word window with a row of known. Only windows that pass a bitmap of the
    known ones are joined, so that the others are neither shuffled nor sorted, however many known ones there are."""
    wanted = gram_hashes(known, known_text, known_text, n).select("gram").distinct()
    sets = gram_sets(df, key, text, n)
    rows = sets.select(key, F.size("grams").cast("long").alias("grams"), F.explode_outer("grams").alias("gram")).where("gram is not null")
    maybe, _ = split_by_ids(rows, "gram", wanted)
    return maybe.join(wanted, "gram", "left_semi").groupBy(key, "grams").agg(F.count("*").alias("shared"))
