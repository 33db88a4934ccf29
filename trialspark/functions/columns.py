"""Column functions: seeded hashes, path parts, order statistics, counts and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_int(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_of(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by colons; a null part reads None."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("None")) for c in columns)), 256)


def h12(*parts: Column | str | int) -> Column:
    return hex_int(hash_of(*parts), 12)


def seed_for(row_id: Column) -> Column:
    return hex_int(F.sha2(row_id.cast("string"), 256), 8)


def attempt_seed(i: Column, digest: Column) -> Column:
    return 1000 * i + hex_int(digest, 6) % 1000


def last_hex_digit(digest: Column) -> Column:
    """A digest modulo 16."""
    return F.conv(F.substring(digest, -1, 1), 16, 10).cast("int")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, "\\.([^./]+)$", 1)


def order_statistic(values: Column, p: float) -> Column:
    """values sorted, at index min(n - 1, floor(p * n)); null for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.array_sort(values), F.least(n - 1, F.floor(F.lit(p) * n).cast("int"))))


def comb(n: Column, k: int) -> Column:
    """n over k, as a double."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(n - i, F.lit(0)) / (i + 1))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def test_function(nodeid: Column) -> Column:
    """The function name of a test id such as path::Class::name[param]."""
    return F.regexp_replace(F.element_at(F.split(nodeid, "::"), -1), "\\[.*$", "")


def joined_ids(prompt: Column, completion: Column) -> Column:
    return F.concat(prompt, completion)


def joined_mask(prompt: Column, mask: Column) -> Column:
    """Nothing of the prompt is trained on."""
    return F.concat(F.array_repeat(F.lit(0), F.size(prompt)), mask)


def command_of(arguments: Column) -> Column:
    """The command in a tool call's JSON arguments; null if there is none or it is no JSON."""
    return F.get_json_object(arguments, "$.command")


def supervised_positions(mask: Column) -> Column:
    """Positions i whose next token is trained on."""
    return F.filter(F.sequence(F.lit(0), F.size(mask) - 2), lambda i: F.get(mask, i + 1) == 1)
