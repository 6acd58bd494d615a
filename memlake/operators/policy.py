"""Who may see what: audiences, applicability of claims, sharing plans. All rules are columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import packs as pk, text as tx
from memlake.session import durable


def glob_regex(pattern: str) -> str:
    """Case-sensitive shell pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1:end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def _meet(sets: Column, start: Column) -> Column:
    return F.aggregate(sets, start, lambda acc, s: F.array_intersect(acc, s))


def audiences(path: Column, default: list[str], rules: list[tuple[str, list[str], bool]]) -> Column:
    """Default, or the intersection of matching grants; then cut by matching restrictions.

    ``rules`` are (glob, audiences, restrict). The rule list is owner configuration, so it becomes
    literals in the plan instead of a join side.
    """
    lits = lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    hit = lambda want: F.array_compact(F.array(*[F.when(path.rlike(glob_regex(g)), lits(a)) for g, a, r in rules if r == want])).cast("array<array<string>>")
    # Bound once each: written out, an array would be worked out again at every mention.
    base = tx.let(hit(False), lambda grants: F.when(F.size(grants) > 0, _meet(grants, F.get(grants, F.lit(0)))).otherwise(lits(default)))
    return F.array_sort(_meet(hit(True), base))


def rule_table(df: DataFrame, most: int = 500) -> list[tuple[str, list[str], bool]]:
    """Rules for ``audiences`` from a table (source, audiences, restrict); one of more than ``most`` rows is refused.

    A missing list grants nobody, and a missing flag restricts: an incomplete rule never widens.
    """
    rows = df.select("source", "audiences", "restrict").where("source IS NOT NULL").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r["source"], list(r["audiences"] or []), True if r["restrict"] is None else r["restrict"]) for r in rows]


def artifact_audiences(external: Column, claim_sets: Column) -> Column:
    """Null when nothing restricts the artifact; else the intersection of its controls."""
    private = F.array(F.lit("host"), F.lit("local"))
    sets = F.concat(F.when(external, F.array().cast("array<array<string>>")).otherwise(F.array(private)), claim_sets)
    return F.when(F.size(sets) > 0, F.array_sort(_meet(sets, F.get(sets, F.lit(0)))))


def shared_values(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, value): values present in every row of the key that has a list. Counts, no collected sets."""
    has = rows.where(F.col(values).isNotNull())
    total = has.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    each = (has.select(key, F.explode_outer(F.array_distinct(values)).alias("value")).where("value IS NOT NULL")
            .groupBy(key, "value").agg(F.count(F.lit(1)).alias("__c")))
    return each.join(total, key).where("__c = __n").select(key, "value")


PRIVATE = ("host", "local")


def _facts(values: DataFrame, key: str, product: str) -> DataFrame:
    """(key, allowed, origins, unresolved): what single values of a record restrict; values that say nothing give no row."""
    kind, name = F.schema_of_variant("v"), F.lower(F.coalesce("name", F.lit("")))
    text = F.when(kind == "STRING", F.variant_get("v", "$", "string"))
    off = F.coalesce(F.when(kind == "BOOLEAN", ~F.variant_get("v", "$", "boolean")), text == "false", F.lit(False))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
    texts = F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")))
    rows = values.select(key, (name == "private").alias("flag"), off.alias("off"), (name == "derivation_sources").alias("cites"), texts.alias("texts"), text.alias("text"))
    rows = rows.where(F.col("flag") | F.col("cites") | F.col("text").contains("<!--") | F.col("text").rlike(r"\A\x{FEFF}?---"))
    claims = pk.claim_records(F.coalesce("text", F.lit("")), product)
    rows = tx.hold(rows, claims.alias("claims"), *[c.alias(n) for c, n in zip(pk.derivations(F.coalesce("text", F.lit("")), product), ("said", "denied"))])
    parsed = F.transform("claims", lambda c: F.struct(F.try_parse_json(c).alias("p")))
    private, none = F.array(*map(F.lit, PRIVATE)), F.array().cast("array<string>")

    def audience(c):
        found = F.try_variant_get(c["p"], "$.audiences", "variant")
        return F.when(F.schema_of_variant(found).startswith("ARRAY"), F.try_variant_get(found, "$", "array<string>")).when(found.isNull(), F.array(F.lit("host")))

    rows = tx.hold(rows, F.transform(parsed, audience).alias("sets"))
    some = F.array_compact(F.concat(F.array(F.when(F.col("flag") & ~F.col("off"), private), F.when(~tx.external_allowed(F.coalesce("text", F.lit(""))), private)), "sets"))
    bad_list = F.col("cites") & (F.col("texts").isNull() | F.exists("texts", lambda x: x.isNull()))
    bad = F.coalesce(bad_list, F.lit(False)) | F.coalesce("denied", F.lit(False)) | F.exists("sets", lambda x: x.isNull() | F.exists(x, lambda a: a.isNull()))
    cited = F.when(F.col("cites") & F.col("texts").isNotNull(), F.array_compact("texts")).otherwise(none)
    return rows.select(key, some.alias("allowed"), F.array_distinct(F.concat(cited, F.coalesce("said", none))).alias("origins"), bad.alias("unresolved"))


def restrictions(records: DataFrame, key: str, raw: str, product: str) -> DataFrame:
    """(key, kind, value): what the JSON records of each key restrict, at any depth.

    Records are parsed once to VARIANT and opened level by level, a wave for each depth, so a deep record costs waves and
    not a deep plan. ``private`` (unless false) and the controls of notes and claims inside strings give audiences,
    of which only those that all allow are left (kind ``audience``; no such row where they share none);
    ``derivation_sources`` gives ``origin`` rows. A record that is no JSON object or repeats a key, a list of origins that is none
    and provenance that cannot be read mark the key ``unresolved``: what was found still restricts.
    A null record counts as one that cannot be read.
    """
    # Parsed inside a list: by itself the parser would stop at the record's end and pass over what follows it.
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]")))
    alone = F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))
    level = durable(records.select(key, alone.alias("v")))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    unread = level.where(~whole).select(key, F.array().cast("array<array<string>>").alias("allowed"), F.array().cast("array<string>").alias("origins"), F.lit(True).alias("unresolved"))
    facts, level = [durable(unread)], level.where(whole)
    explode = records.sparkSession.tvf.variant_explode
    while True:
        parts = level.select(key, "v").lateralJoin(explode(F.col("v").outer())).select(key, F.col("key").alias("name"), F.col("value").alias("v"))
        opened = durable(parts)
        if opened.isEmpty():
            break
        facts.append(durable(_facts(opened, key, product)))
        kind = F.schema_of_variant("v")
        level = opened.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    sets = every.select(key, F.explode("allowed").alias("set"))
    audience = shared_values(sets, key, "set").select(key, F.lit("audience").alias("kind"), "value")
    origin = every.select(key, F.lit("origin").alias("kind"), F.explode("origins").alias("value")).distinct()
    return audience.unionByName(origin).unionByName(every.where("unresolved").select(key, F.lit("unresolved").alias("kind"), F.lit("true").alias("value")).distinct())


def claim_reasons(scope: dict[str, tuple[Column, str]], valid_from: Column, valid_until: Column, allowed: Column,
                  wanted: list[str], now: Column) -> Column:
    """Reason codes that keep a claim from applying; empty when it applies."""
    codes = []
    for name, (required, given) in scope.items():
        codes.append(F.when((F.coalesce(required, F.lit("")) != "") & (required != F.lit(given)),
                            F.lit(("unknown-" if given == "" else "scope-") + name)))
    codes += [F.when(now < valid_from, "not-yet-valid"), F.when(now >= valid_until, "expired"),
              F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), allowed)) > 0, "audience-denied")]
    return F.array_compact(F.array(*codes))
