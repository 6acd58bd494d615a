"""Note catalogue joins: related notes, diffs, proofs, merge rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related(notes: DataFrame, keywords: list[str], tags: list[str]) -> DataFrame:
    """Score notes by file name 100/50, alias 80/40, tag 30, title 20 and preview 5 per keyword."""
    words = [k.lower() for k in keywords]

    def graded(c: Column, whole: int, part: int) -> Column:
        return sum((F.when(c == w, whole).when(c.contains(w), part).otherwise(0) for w in words), F.lit(0))

    alias = F.aggregate(F.col("aliases"), F.lit(0), lambda acc, a: acc + graded(F.lower(a), 80, 40))
    tagged = F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags]))) * 30
    shown = sum((F.when(F.lower("title").contains(w), 20).otherwise(0) + F.when(F.lower("preview").contains(w), 5).otherwise(0) for w in words), F.lit(0))
    score = graded(F.lower("stem"), 100, 50) + alias + tagged + shown
    return notes.withColumn("score", score.cast("bigint"))


PATTERNS = 20_000  # keywords of one automaton; more are looked for in several passes


def keyword_points(notes: DataFrame, key: str, words: DataFrame, patterns: int = PATTERNS) -> DataFrame:
    """(key, keyword, points): what each keyword of ``words`` (keyword, lower case) earns in each note that holds it.

    File name 100 for the whole, 50 for a part; each alias 80 or 40; title 20 and preview 5. All keywords of a pass are
    looked for at once by one automaton, so a note is read once however many keyword sets there are.
    """
    texts = notes.select(key, F.lower("stem").alias("stem"), F.transform("aliases", lambda a: F.lower(a)).alias("aliases"), F.lower("title").alias("title"), F.lower("preview").alias("preview"))
    words = words.select("keyword").where("keyword <> ''").distinct()
    passes = -(-words.count() // patterns)
    out = None
    for i in range(max(passes, 1)):
        some = words.where(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == i) if passes > 1 else words
        sent = [r.keyword for r in some.toLocalIterator()]  # about ``patterns`` words

        def score(batches: Iterator[pa.RecordBatch], sent: list[str] = sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in sent:
                machine.add_word(w, w)
            machine.make_automaton()
            for b in batches:
                rows: list[int] = []
                keywords: list[str] = []
                points: list[int] = []
                fields = [b.column(c).to_pylist() for c in ("stem", "title", "preview", "aliases")]
                for k, (stem, title, preview, aliases) in enumerate(zip(*fields)):
                    earned: dict[str, int] = {}
                    for text, whole, part in ((stem, 100, 50), (title, 20, 20), (preview, 5, 5), *((a, 80, 40) for a in aliases or ())):
                        for w in {w for _, w in machine.iter(text)} if text and sent else ():
                            earned[w] = earned.get(w, 0) + (whole if w == text else part)
                    rows += [k] * len(earned)
                    keywords += earned
                    points += earned.values()
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(keywords, pa.string()), pa.array(points, pa.int64())], names=[key, "keyword", "points"])

        found = texts.mapInArrow(score, f"`{key}` {notes.schema[key].dataType.simpleString()}, keyword string, points bigint")
        out = found if out is None else out.unionByName(found)
    return out


def related_sets(notes: DataFrame, key: str, owner: str, keywords: DataFrame, tags: DataFrame) -> DataFrame:
    """(owner, key, score): notes related to each of many keyword sets, scored as ``related`` does for one.

    ``keywords`` (owner, keyword) and ``tags`` (owner, tag) are tables; a keyword counts as often as its set names it, a tag
    30 points once. Blank keywords say nothing. Notes without points give no row.
    """
    asked = keywords.select(owner, F.lower("keyword").alias("keyword"))
    earned = keyword_points(notes, key, asked).join(asked, "keyword").select(owner, key, "points")
    tagged = (notes.select(key, F.explode(F.array_distinct("tags")).alias("tag")).join(tags.select(owner, "tag").distinct(), "tag")
              .select(owner, key, F.lit(30).cast("bigint").alias("points")))
    return earned.unionByName(tagged).groupBy(owner, key).agg(F.sum("points").alias("score"))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    j = old.withColumnRenamed(digest, "__o").join(new.withColumnRenamed(digest, "__n"), key, "full_outer")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("__o") != F.col("__n"), "changed")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")


def merge_rule(enabled: Column, sources: Column, origins: Column, size: Column, new: Column, most: int = 5, largest: int = 24_000) -> Column:
    return (F.when(~enabled, "merge disabled").when(sources >= most, "concept source limit reached").when(origins == 0, "actual source path unavailable")
            .when(size > largest, "existing note exceeds bounded merge assessment").when(~new, "no new addition").otherwise("merge"))


def reconcile(tracked: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Tracked revisions that were edited, deleted, or cannot be judged yet."""
    j = tracked.join(current, key, "left")
    outcome = (F.when(F.col("status") != "saved", "skipped").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("revision"), "edited"))
    return j.select(key, outcome.alias("outcome")).where("outcome IS NOT NULL")


def proof(tracked: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Reason code per tracked revision; the index proves a scope only when every code is ok."""
    held = index.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and("active").alias("active"), F.max("hash").alias("hash"),
        F.max(F.sha2("doc", 256)).alias("body"), F.bool_and(F.sha2("fts", 256) == F.sha2("doc", 256)).alias("same"))
    j = tracked.join(held, key, "left")
    code = (F.when(F.col("rows").isNull(), "proof_revision_absent").when(F.col("rows") > 1, "proof_revision_ambiguous").when(~F.col("active"), "proof_revision_inactive")
            .when(F.col("hash") != F.col("revision"), "proof_revision_mismatch").when(F.col("body") != F.col("revision"), "proof_content_hash_mismatch")
            .when(~F.col("same"), "proof_fts_mismatch").otherwise("ok"))
    return j.withColumn("code", code)


def verdicts(proved: DataFrame, scope: str) -> DataFrame:
    """(scope, proved, first_failure, tracked): an index proves all of a scope's revisions or none of them."""
    bad = F.col("code") != "ok"
    return proved.groupBy(scope).agg((~F.bool_or(bad)).alias("proved"), F.min(F.when(bad, F.col("code"))).alias("first_failure"), F.count(F.lit(1)).alias("tracked"))
