"""Failure rules as Column expressions over logged command results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import fixed
from memlake.functions.text import find_all, hold, let, sub


def failure_text(tool: Column, exit_code: Column, stderr: Column, stdout: Column) -> Column:
    """Output of a failed command; '' when nothing failed. Zero exits count on stderr alone."""
    failed = F.coalesce(exit_code != 0, F.lit(False))
    err, out = F.coalesce(stderr, F.lit("")), F.coalesce(stdout, F.lit(""))
    return (F.when(~F.coalesce(tool, F.lit("")).isin("", "Bash"), "")
            .when(failed, F.concat(err, F.lit("\n"), F.right(out, F.lit(4000))))
            .when(err.rlike(fixed.ERROR_LINE), err).otherwise(""))


def evidence(c: Column) -> Column:
    """Text without the structured data lines."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda l: ~l.rlike(fixed.DATA_LINE)), "\n")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda l: F.trim(l)), lambda l: l != "")


def error_line(c: Column) -> Column:
    """Most specific error line: a tool's own diagnostic, then wordy, then late."""
    last = let(_lines(c), lambda ls: F.when(F.size(ls) > 60, F.slice(ls, -60, 60)).otherwise(ls))

    def scored(l, i):
        words = F.size(find_all(l, "[A-Za-z]{3,}"))
        score = F.least(words, F.lit(12)) * 2 + F.when(l.rlike(fixed.DIAGNOSTIC), 100).otherwise(0)
        counts = l.rlike(fixed.ERROR_LINE) & ~l.rlike(fixed.DATA_LINE)
        return F.when(counts, F.struct(score.alias("s"), i.alias("i"), l.alias("l")))

    best = F.array_max(F.transform(last, scored))
    return F.substring(F.coalesce(best["l"], F.lit("")), 1, 300)


def fallback_line(c: Column) -> Column:
    def pick(lines):
        head = F.get(lines, F.lit(0))
        return F.substring(F.when(head.rlike(fixed.EXIT_HEADER), head).otherwise(F.get(lines, F.size(lines) - 1)), 1, 300)
    return F.coalesce(let(_lines(c), pick), F.lit(""))


def classify(c: Column, command: Column, exit_code: Column, stderr: Column, code: Column | None = None, status: Column | None = None,
             retry_header: Column | None = None) -> tuple[Column, Column]:
    """(class, retry_after seconds or null) of the evidence text ``c``.

    ``code``, ``status`` and ``retry_header`` are the provider's structured fields; where they are there, they
    come before what the text says.
    """
    none = F.lit(None).cast("string")
    code, given = F.lower(F.coalesce(none if code is None else code, F.lit(""))), none if status is None else status.cast("string")
    retry_header = none if retry_header is None else retry_header
    tool = F.element_at(F.split(F.element_at(F.split(F.trim(command), r"\s+"), 1), "/"), -1)
    quiet = ((exit_code == 1) & (F.coalesce(stderr, F.lit("")) == "") & tool.isin(fixed.QUIET_TOOLS)
             & ~command.rlike(r"[;|]|&&"))
    active_text = F.lower(sub(c, fixed.NEGATED_CREDENTIAL, ""))
    seen = F.struct(active_text.alias("text"), F.concat(code, F.lit("\n"), active_text).alias("all"),
                    F.coalesce(given, F.regexp_extract(c, fixed.HTTP_STATUS, 1)).alias("status"))

    def named(s):
        active, said, status = s["text"], s["all"], s["status"]
        return (F.when(said.rlike(fixed.BUDGET), "budget")
                .when(said.rlike(fixed.RESOURCE), "resource")
                .when(said.rlike(fixed.AUTHENTICATION) | (status == "401") | active.rlike(fixed.AUTHENTICATION_401), "authentication")
                .when((status == "403") | said.rlike(fixed.AUTHORIZATION), "authorization")
                .when(status.isin("429", "502", "503", "504") | said.rlike(fixed.TRANSIENT), "transient")
                .when(status.isin("400", "422") | said.rlike(fixed.INVALID_INPUT), "invalid_input")
                .otherwise("unknown"))

    kind = F.when(quiet, "expected_nonzero").otherwise(let(seen, named))
    retry = F.nullif(F.regexp_extract(active_text, fixed.RETRY_AFTER, 1), F.lit(""))
    return kind, F.when(~quiet, F.coalesce(retry_header.try_cast("bigint"), retry.cast("bigint")))


def rule_table(df, most: int = 500) -> list[tuple[str, str]]:
    """(name, pattern) rows of a user's rule table in the order of its ``position``; a table of more than ``most`` is refused.

    Rules are owner configuration: they become literals of the plan, not a join side.
    """
    rows = df.select("position", "name", "pattern").where("pattern IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r["name"], r["pattern"]) for r in sorted(rows, key=lambda r: (r["position"], r["name"]))]


def advice(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct advice of every rule whose pattern occurs, in rule order."""
    hits = F.array(*[F.when(c.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in rules])
    return F.array_distinct(F.array_compact(hits))


def identifiers(line: Column, limit: int = 3) -> Column:
    """Up to ``limit`` identifiers that mean one thing on their own."""
    bare = sub(sub(sub(line, fixed.URL, " "), fixed.DOTTED, " "), fixed.ERROR_NOISE, " ")
    found = F.filter(find_all(bare, fixed.FAILURE_IDENTIFIER), lambda t: ~F.upper(t).isin(fixed.COMMON_IDENTIFIERS))
    def distinct(ts):
        low = F.transform(ts, lambda o: F.lower(o))
        return F.filter(F.transform(ts, lambda t, i: F.when(F.array_position(low, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return F.slice(let(found, distinct), 1, limit)


def signature(kind: Column, line: Column) -> Column:
    return F.substring(F.sha1(F.concat(kind, F.lit("\n"), F.regexp_replace(line, r"\d+", "#"))), 1, 12)


def analysed(df):
    """Failed commands with their best line, class, retry delay and signature."""
    text = failure_text(F.col("tool_name"), F.col("exit_code"), F.col("stderr"), F.col("stdout"))
    rows = hold(df, text.alias("failure")).where("failure <> ''")
    proof = F.right(evidence(F.col("failure")), F.lit(6000))
    fields = [F.col(c) if c in df.columns else None for c in ("code", "status_code", "retry_header")]
    kind, retry = classify(F.col("evidence"), F.col("command"), F.col("exit_code"), F.col("stderr"), *fields)
    best = error_line(F.col("failure"))
    return (rows.withColumn("evidence", proof)
            .withColumn("line", F.coalesce(F.nullif(best, F.lit("")), fallback_line(F.col("failure"))))
            .withColumn("kind", kind).withColumn("retry_after", retry)
            .withColumn("signature", signature(F.col("kind"), F.col("line"))))
