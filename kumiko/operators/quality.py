"""Quality rules that give one table of issues, and reports.

Defined results. Rules hold within a version: tables of fields, pairs and groups have a `version`, and two versions never meet in
a rule. A null name, code, kind or mode counts as empty; a null number is left out of the rule on missing ones. A master or table
without any row has that one error and no other. Repeated rows each have their issues. Empty tables have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .names import unused
from .sequence import missing_runs

#: Thresholds of the rule on missing numbers: a count, and a share as a ratio of integers; and how many are shown.
MISSING_COUNT, MISSING_SHARE, MISSING_SHOWN = 20, (1, 5), 20
#: Ends of names that a column break has cut, and how long such a name may be.
CUT_ENDS, CUT_LENGTH = ("グルー", "コ", "ロ"), 12
MODES = ("numeric", "alphanumeric", "text", "date", "")
LONG_CODE_NAME = 200
PAIRS, GROUPS = "codeNamePairs", "nayoseGroups"
#: What an issue says beside its master or table.
ISSUE = "severity string, rule string, message string, seq int, idx int, code string, missing_count long, missing_ratio double"
_PARTS = [x.strip().split() for x in ISSUE.split(",")]


def issue(df: DataFrame, kind: str, entity: Column, severity: Column | str, rule: str, message: Column | str, **extra: Column) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(kind).alias("entity_kind"), entity.cast("string").alias("entity_id"), col(severity).alias("severity"), F.lit(rule).alias("rule"), col(message).alias("message"), *(c.alias(n) for n, c in extra.items()))


def all_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_issues(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, expected, missing_count, missing_ratio, severity and first_missing (20 at most, joined) where numbers are missing."""
    gaps = missing_runs(df, keys, number).filter("missing_count > 0")
    a, b = MISSING_SHARE
    bad = (F.col("missing_count") >= MISSING_COUNT) | (F.col("missing_count") * b >= F.col("expected") * a)
    near = lambda r: F.sequence(r["gap_from"], F.least(r["gap_to"], r["gap_from"] + (MISSING_SHOWN - 1)))
    shown = F.slice(F.flatten(F.transform(F.slice("runs", 1, MISSING_SHOWN), near)), 1, MISSING_SHOWN)
    return gaps.select(
        *keys, "expected", "missing_count", F.round(F.col("missing_count") / F.col("expected"), 3).alias("missing_ratio"), F.when(bad, "error").otherwise("warning").alias("severity"),
        F.concat(F.array_join(shown, ", "), F.when(F.col("missing_count") > MISSING_SHOWN, "...").otherwise("")).alias("first_missing"),
    )


def duplicates(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The rows whose keys stand at an earlier place as well, with that first place (first_pos)."""
    first = F.min(pos).over(Window.partitionBy(*keys))
    return df.withColumn("first_pos", first).filter(F.col(pos) > F.col("first_pos"))


def not_in_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The rows whose value isn't one of `allowed`; null counts as empty."""
    return df.filter(~F.coalesce(column, F.lit("")).isin(*allowed))


def not_digits(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value is there but isn't digits alone."""
    return df.filter((F.coalesce(column, F.lit("")) != "") & ~T.all_digits(F.col(column)))


def too_long(df: DataFrame, column: str, most: int = LONG_CODE_NAME) -> DataFrame:
    return df.filter(F.length(column) > most)


def name_rule(name: Column) -> Column:
    """empty, newline or cut: the first rule that a name breaks, else null."""
    last = F.element_at(F.split(name, "/"), -1)
    cut = reduce(lambda a, b: a | b, (F.endswith(last, F.lit(e)) for e in CUT_ENDS)) & (F.length(name) <= CUT_LENGTH)
    return F.when(F.coalesce(name, F.lit("")) == "", "empty").when(name.contains("\n"), "newline").when(cut, "cut")


def _quoted(x: Column) -> Column:
    """A text in quotes, line feeds and backslashes spelled out."""
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("'"))


def _entry(when: Column, severity: str, rule: str, message: Column | str, **values: Column) -> Column:
    given = {"severity": F.lit(severity), "rule": F.lit(rule), "message": F.lit(message) if isinstance(message, str) else message, **values}
    return F.when(when, F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _PARTS)))


def _exploded(df: DataFrame, kind: str, entity: str, place: str, entries: list[Column]) -> DataFrame:
    """One row for each entry that isn't null: version, entity_kind, entity_id, place, rank and ISSUE. The table is read once."""
    found = df.select("version", F.lit(kind).alias("entity_kind"), F.col(entity).cast("string").alias("entity_id"), F.col(place).cast("long").alias("place"), F.posexplode(F.array(*entries)).alias("rank", "i"))
    return found.filter("i is not null").select("version", "entity_kind", "entity_id", "place", "rank", "i.*")


def field_issues(fields: DataFrame) -> DataFrame:
    """Issues of master fields (version, master_id, field_pos, seq, name, mode, codes: array of code, name), in order of
    entity_id, place and rank; missing numbers stand before all fields."""
    gaps = missing_issues(fields, ["version", "master_id"], "seq").withColumn("place", F.lit(-1))
    message = F.concat(F.lit("missing seq numbers: ["), F.regexp_replace("first_missing", r"\.\.\.$", ""), F.lit("]"), F.when(F.col("missing_count") > MISSING_SHOWN, "...").otherwise(""))
    entry = [_entry(F.col("severity") == s, s, "missing", message, missing_count=F.col("missing_count"), missing_ratio=F.col("missing_ratio")) for s in ("error", "warning")]
    rule, seq, mode = name_rule(F.col("name")), F.col("seq"), F.coalesce("mode", F.lit(""))
    of_row = [
        _entry(rule == "empty", "error", "empty name", "empty name", seq=seq),
        _entry(rule == "newline", "warning", "line break in name", F.concat(F.lit("name contains newline: "), _quoted(F.col("name"))), seq=seq),
        _entry(rule == "cut", "warning", "name may be cut", F.concat(F.lit("name may be truncated mid-word: "), _quoted(F.col("name"))), seq=seq),
        _entry(~mode.isin(*MODES), "warning", "unknown mode", F.concat(F.lit("unexpected mode value: "), _quoted(mode)), seq=seq),
    ]
    long = too_long(fields.select("version", "master_id", "field_pos", "seq", F.posexplode("codes").alias("code_pos", "c")).select("*", "c.code", "c.name"), "name")
    of_code = _entry(F.lit(True), "warning", "long code name", f"code name too long (>{LONG_CODE_NAME} chars); may contain spillover description", seq=seq, code=F.col("code"))
    codes = _exploded(long, "master", "master_id", "field_pos", [of_code]).withColumn("rank", F.lit(len(of_row)))
    return _exploded(gaps, "master", "master_id", "place", entry).unionByName(_exploded(fields, "master", "master_id", "field_pos", of_row)).unionByName(codes)


def pair_issues(pairs: DataFrame) -> DataFrame:
    """Issues of code tables of pairs (version, table_id, pos, code, name)."""
    code, name, idx = F.coalesce("code", F.lit("")), F.coalesce("name", F.lit("")), F.col("pos")
    first = unused("first", pairs)
    rows = pairs.withColumn(first, F.min("pos").over(Window.partitionBy("version", "table_id", code)))
    return _exploded(rows, "codetable", "table_id", "pos", [
        _entry(code == "", "error", "empty code", "empty code", idx=idx),
        _entry((code != "") & ~T.all_digits(code), "warning", "code isn't a number", "non-digit code", idx=idx, code=code),
        _entry(name == "", "error", "empty name", "empty name", idx=idx, code=code),
        _entry(idx > F.col(first), "warning", "code repeats", F.format_string("duplicate code (also at index %d)", first), code=code),
    ])


def group_issues(groups: DataFrame) -> DataFrame:
    """Issues of code tables of groups (version, table_id, group_pos, target_code, target_name, n_sources)."""
    empty, idx = (lambda c: F.coalesce(c, F.lit("")) == ""), F.col("group_pos")
    return _exploded(groups, "codetable", "table_id", "group_pos", [
        _entry(empty("target_code"), "error", "empty target code", "empty targetCode", idx=idx),
        _entry(empty("target_name"), "warning", "empty target name", "empty targetName", idx=idx, code=F.col("target_code")),
        _entry(F.coalesce("n_sources", F.lit(0)) <= 0, "warning", "no sources", "no sources", idx=idx, code=F.col("target_code")),
    ])


def table_issues(masters: DataFrame, tables: DataFrame, fields: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """All issues of the masters (version, master_id) and code tables (version, table_id, kind): those of their rows, or that
    there are none, or that the kind isn't known."""

    def none(headers: DataFrame, rows: DataFrame, key: str, kind: str, message: str) -> DataFrame:
        bare = headers.join(rows.select("version", key), ["version", key], "left_anti").withColumn("place", F.lit(-1))
        return _exploded(bare, kind, key, "place", [_entry(F.lit(True), "error", "no rows", message)])

    given = F.coalesce("kind", F.lit(""))
    unknown = not_in_domain(tables, "kind", (PAIRS, GROUPS)).withColumn("place", F.lit(-1))
    parts = [
        none(masters, fields, "master_id", "master", "no fields extracted"), field_issues(fields),
        none(tables.filter(given == PAIRS), pairs, "table_id", "codetable", "no codes extracted"), pair_issues(pairs),
        none(tables.filter(given == GROUPS), groups, "table_id", "codetable", "no groups extracted"), group_issues(groups),
        _exploded(unknown, "codetable", "table_id", "place", [_entry(F.lit(True), "warning", "unknown kind", F.concat(F.lit("unknown kind: "), F.coalesce(_quoted(F.col("kind")), F.lit("None"))))]),
    ]
    return all_issues(parts)


def without_rows(headers: DataFrame, rows: DataFrame, key: str, kind: str) -> DataFrame:
    """An error for each header that has no row; other rules have nothing to say of it."""
    return issue(headers.join(rows.select(key).distinct(), key, "left_anti"), kind, F.col(key), "error", "no rows", "")


def report(entities: DataFrame, issues: DataFrame, key: str = "entity_id") -> DataFrame:
    """key, n_issues, n_errors, ok for each entity."""
    counts = issues.groupBy(key).agg(F.count("*").alias("n_issues"), F.sum((F.col("severity") == "error").cast("int")).alias("n_errors"))
    out = entities.select(key).join(counts, key, "left").select(key, F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"))
    return out.withColumn("ok", F.col("n_errors") == 0)
