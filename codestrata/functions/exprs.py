"""Scalar rules. Each takes and returns columns, so that plans stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_js(x: Column | str, digits: int = 0) -> Column:
    """Half up on the binary product, as floor(x 10^d + 0.5) / 10^d; F.round rounds 1.005 to 1.01 instead of 1.0."""
    k = float(10**digits)
    return F.floor(col(x) * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def pct1(part: Column | str, whole: Column | str) -> Column:
    """A percentage with one decimal; 0 of nothing."""
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5).cast("double") / 10).otherwise(F.lit(0.0))


def ratio(part: Column | str, whole: Column | str, digits: int) -> Column:
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(whole > 0, round_js(part / whole, digits)).otherwise(F.lit(0.0))


def zero(agg: Column) -> Column:
    """Summaries of nothing are 0."""
    return F.coalesce(agg, F.lit(0))


def median0(x: Column | str) -> Column:
    return F.coalesce(F.median(col(x)), F.lit(0.0))


def pctl_floor(x: Column | str, p: float) -> Column:
    """The element at place min(floor(p n), n - 1) of the sorted values; no interpolation, 0 of nothing. Gathers a group's values:
    for groups beyond a few million use ``operators.distributions.floor_percentiles``."""
    values = F.sort_array(F.collect_list(col(x)))
    n = F.size(values)
    return F.coalesce(F.get(values, F.least(F.floor(F.lit(p) * n), n - 1).cast("int")).cast("double"), F.lit(0.0))


def count_lines(text: Column | str) -> Column:
    """Line breaks plus one, less one if the text ends in one; 0 of an empty or null text."""
    t = F.coalesce(col(text), F.lit(""))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(breaks + F.when(F.endswith(t, F.lit("\n")), 0).otherwise(1)).cast("long")


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: code points beyond the first 65536 count twice."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("long")


def leading_int(text: Column | str) -> Column:
    """The number that a text starts with; 0 if there is none."""
    return F.coalesce(F.regexp_extract(col(text), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def is_test_file(path: Column | str) -> Column:
    return col(path).rlike(C.TEST_FILE)


def is_source_file(path: Column | str) -> Column:
    """Has a source suffix and no ignored directory above it."""
    p = col(path)
    inside = F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), F.array(*map(F.lit, C.IGNORED_DIRECTORIES)))
    return (F.endswith(p, F.lit(".ts")) | F.endswith(p, F.lit(".tsx"))) & ~inside


def flavor(path: Column | str) -> Column:
    return F.when(F.endswith(col(path), F.lit(".tsx")), "tsx").otherwise("ts")


def is_function(kind: Column | str) -> Column:
    return col(kind).isin(*C.FUNCTION_TYPES)


def is_nesting(kind: Column | str) -> Column:
    return col(kind).isin(*C.NESTING_TYPES)


def is_branch(kind: Column | str, operator: Column | str) -> Column:
    k = col(kind)
    return k.isin(*C.BRANCH_TYPES) | ((k == "binary_expression") & F.coalesce(col(operator).isin(*C.BRANCH_OPERATORS), F.lit(False)))


def is_refactor_subject(subject: Column | str) -> Column:
    return F.coalesce(col(subject).rlike(C.REFACTOR_SUBJECT), F.lit(False))


def parse_repo_url(url: Column | str) -> Column:
    """struct(owner, repo, url) of an https repository address, null for anything else."""
    plain = F.regexp_replace(F.trim(col(url)), "/+$", "")
    owner = F.regexp_extract(plain, C.REPO_URL, 1)
    repo = F.regexp_replace(F.regexp_extract(plain, C.REPO_URL, 2), r"\.git$", "")
    parsed = F.struct(owner.alias("owner"), repo.alias("repo"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo).alias("url"))
    return F.when((owner != "") & (F.regexp_extract(plain, C.REPO_URL, 2) != ""), parsed)


def looks_like_repo_url(text: Column | str) -> Column:
    return F.startswith(F.lower(F.trim(col(text))), F.lit("https://github.com/"))


def normalise_repo_url(text: Column | str) -> Column:
    """Addresses stay, owner/repo becomes one, anything else gets https:// in front."""
    t = F.trim(col(text))
    return F.when(t.rlike("^https?://"), t).when(t.rlike(C.OWNER_REPO), F.concat(F.lit("https://github.com/"), t)).otherwise(F.concat(F.lit("https://"), t))


def is_valid_repo_input(text: Column | str) -> Column:
    t = F.trim(F.coalesce(col(text), F.lit("")))
    return (t != "") & (t.rlike(C.OWNER_REPO) | t.rlike(C.LOOSE_URL))


def contains_ignoring_case(text: Column | str, needle: str) -> Column:
    return F.contains(F.lower(col(text)), F.lit(needle.lower()))


def badges(complexity: Column | str, lines: Column | str) -> Column:
    """Views flag from the threshold on, summaries only above it."""
    return F.array_compact(F.array(F.when(col(complexity) >= C.HIGH_COMPLEXITY, "High"), F.when(col(lines) >= C.LONG_FUNCTION, "Long")))


def short_commit(commit: Column | str) -> Column:
    return F.substring(col(commit), 1, 7)


def result_id(owner: Column | str, repo: Column | str, commit: Column | str) -> Column:
    """owner-repo and 12 digits of the commit, or of a fresh identifier if there is none."""
    c = F.coalesce(col(commit), F.lit(""))
    return F.concat_ws("-", col(owner), col(repo), F.when(c != "", F.substring(c, 1, 12)).otherwise(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))


def display_number(x: Column | str, digits: int = 2) -> Column:
    v = col(x).cast("double")
    return F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).when(v.isNotNull(), F.format_string(f"%.{digits}f", v))


def export_name(result: Column | str, commit: Column | str, stamp: Column | str) -> Column:
    """id_commit7_time, the name of an exported file."""
    when = F.coalesce(F.substring(F.regexp_replace(F.date_format(col(stamp), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[:.]", "-"), 1, 19), F.lit("export"))
    return F.concat_ws("_", F.regexp_replace(col(result), r"[/\\]", "_"), F.coalesce(short_commit(commit), F.lit("n/a")), when)


def download_name(result: Column | str, commit: Column | str) -> Column:
    """name-id-commit7.json, the name of a downloaded report; the name is this engine's."""
    return F.concat(F.lit("codestrata-"), col(result), F.lit("-"), F.coalesce(short_commit(commit), F.lit("—")), F.lit(".json"))


def repo_label(source_type: Column | str, url: Column | str, path: Column | str) -> Column:
    return F.when(col(source_type) == "git", col(url)).otherwise(col(path))


def git_unavailable(message: Column | str, code: Column | str) -> Column:
    """``is_git_unavailable`` of columns."""
    return F.coalesce(col(code) == "ENOENT", F.lit(False)) | F.coalesce(col(message).rlike(f"(?i){C.NO_GIT}"), F.lit(False))


def is_git_unavailable(message: str, code: str | None = None) -> bool:
    """Whether an error means that there is no git program, the only one after which archives are tried."""
    return code == "ENOENT" or re.search(C.NO_GIT, message, re.IGNORECASE) is not None
