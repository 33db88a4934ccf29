"""Verdicts: test phases, listed ids, rewards, scores, mutants, validity and admission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase_verdicts(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, passed, total, success, missing for inventory (run_id, nodeid) and results (run_id, nodeid, setup, call, teardown):
    a test passes if setup and call pass and teardown does not fail; an inventory test without a result is an error and
    nothing of the run counts as passed. An id listed twice counts once."""
    j = inventory.select("run_id", "nodeid").distinct().join(results, ["run_id", "nodeid"], "left")
    ok = (F.col("setup") == "passed") & (F.col("call") == "passed") & (F.coalesce("teardown", F.lit("passed")) != "failed")
    v = j.groupBy("run_id").agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("ok"), F.count("*").alias("total"), F.count_if(F.col("setup").isNull()).alias("missing"))
    return v.select("run_id", F.when(F.col("missing") > 0, 0).otherwise(F.col("ok")).cast("long").alias("passed"), "total", ((F.col("missing") == 0) & (F.col("ok") == F.col("total"))).alias("success"), "missing")


def listed_ids(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """run_id, pass, rule, n_ids, n_pass for runs (run_id, log) and ids (run_id, test_id): all listed ids stand as PASSED in the
    log, or else its summary counts passes and no failures."""
    lines = runs.select("run_id", F.explode(F.regexp_extract_all("log", F.lit("(?m)^(PASSED|FAILED|ERROR) (\\S+)"), 0)).alias("line"))
    seen = lines.select("run_id", F.split("line", " ", 2)[0].alias("outcome"), F.replace(F.split("line", " ", 2)[1], F.lit("\\\\"), F.lit("\\")).alias("test_id"))
    seen = seen.groupBy("run_id", "test_id").agg(F.max(F.col("outcome") == "PASSED").alias("ok"))
    per = ids.join(seen, ["run_id", "test_id"], "left").groupBy("run_id").agg(F.count("*").alias("n_ids"), F.count_if(F.coalesce("ok", F.lit(False))).alias("n_pass"))
    count = {w: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("log", f"(\\d+) {w}", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0)) for w in ("passed", "failed", "error")}
    s = runs.select("run_id", ((count["passed"] > 0) & (count["failed"] == 0) & (count["error"] == 0)).alias("by_summary"))
    j = s.join(per, "run_id", "left").na.fill(0, ["n_ids", "n_pass"])
    by_ids = (F.col("n_ids") > 0) & (F.col("n_pass") == F.col("n_ids"))
    return j.select("run_id", (by_ids | F.col("by_summary")).alias("pass"), F.when(by_ids, "ids").when(F.col("by_summary"), "summary").alias("rule"), "n_ids", "n_pass")


def score_of(text: Column) -> tuple[Column, Column]:
    """(score, error) of a score text: a number from 0 to 1, else 0 and an error; no number, infinities and NaN are errors."""
    x = F.trim(text).try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & x.between(0, 1)
    return F.when(good, x).otherwise(0.0), ~F.coalesce(good, F.lit(False))


# What an unreadable file looks like in a tool's output.
READ_ERRORS = ("Permission denied", "EACCES", "unable to open", "Unable to open", "cannot open", "can't open", "Cannot open", "No such file", "cannot access", "not found", "does not exist", "no such table")


def fault_observed(family: Column, target: Column, command: Column, output: Column, timed_out: Column) -> Column:
    """Whether a tool call showed its fault to the agent: the target's base name stands in the command or the output, and the output
    has the symptom of the family (perm_denied: a read error, or a mode line of the file without any permission; moved_input: a
    read error; blocking_fifo: a timeout). missing_tool: the whole target in the output and a missing command. Other families are
    never seen; null texts are empty."""
    command, output = F.coalesce(command, F.lit("")), F.coalesce(output, F.lit(""))
    base = F.regexp_extract(target, "[^/]*$", 0)
    touched = command.contains(base) | output.contains(base)
    any_of = lambda *signs: reduce(lambda a, b: a | b, (output.contains(x) for x in signs))
    mode_line = F.exists(F.split(output, "\r\n|\r|\n"), lambda line: F.ltrim(line).startswith("----------") & line.contains(base))
    error = any_of(*READ_ERRORS)
    seen = (
        F.when(family == "perm_denied", touched & (mode_line | error)).when(family == "moved_input", touched & error)
        .when(family == "missing_tool", output.contains(target) & any_of("command not found", "No such file", "not found")).when(family == "blocking_fifo", F.coalesce(timed_out, F.lit(False)) & touched)
    )
    return F.coalesce(seen, F.lit(False))


def discrimination(mutants: DataFrame) -> DataFrame:
    """task, outputs, passes for mutants (task, output, mutant, result caught, survived or n/a): of m1 to m3 one at least is caught
    and none survives; all outputs must pass."""
    three = mutants.where(F.col("mutant").isin("m1", "m2", "m3"))
    per = three.groupBy("task", "output").agg(F.bool_or(F.col("result") == "caught").alias("caught"), F.bool_or(F.col("result") == "survived").alias("survived"))
    return per.groupBy("task").agg(F.count("*").alias("outputs"), F.bool_and(F.col("caught") & ~F.col("survived")).alias("passes"))


def mutants_of(text: Column) -> list[tuple[str, Column]]:
    """Texts that a grader should reject: empty, without the last line, first digit plus one, first line twice; null if unchanged."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = F.array_join(F.slice(lines, 1, F.greatest(n - 1, F.lit(0))), "\n")
    digit = F.regexp_extract(text, "[0-9]", 0)
    at = F.regexp_instr(text, F.lit("[0-9]"))
    bumped = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.translate(digit, "0123456789", "1234567890"), F.substring(text, at + 1, F.char_length(text)))).otherwise(text)
    doubled = F.concat(F.get(lines, F.lit(0)), F.lit("\n"), text)
    return [(name, F.when(m != text, m)) for name, m in (("m1", F.when(text.isNotNull(), F.lit(""))), ("m2", cut), ("m3", bumped), ("m4", doubled))]


def valid(noop_passes: Column, noop_error: Column, references: Column, same_writes: Column, same_tests: Column, fixtures_touched: Column, damage_caught: Column) -> Column:
    """The rule of a valid task: doing nothing fails without an error, both references pass and agree, nothing protected changes."""
    return ~noop_passes & ~noop_error & references & same_writes & same_tests & ~fixtures_touched & damage_caught


def fault_usable(bite: Column, repaired: Column, clean: Column, cleared: Column, forgery_caught: Column) -> Column:
    return bite & repaired & clean & cleared & forgery_caught


def admission(reasons: dict[str, Column], pending: Column | None = None) -> tuple[Column, Column]:
    """(status, reasons): pending where the review is missing, admissible without any reason, else rejected with all of them."""
    why = F.array_compact(F.array(*(F.when(flag, name) for name, flag in reasons.items())))
    status = F.when(F.size(why) == 0, "admissible").otherwise("rejected")
    return (status if pending is None else F.when(pending, "pending").otherwise(status)), why
