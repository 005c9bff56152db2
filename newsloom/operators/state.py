"""State from logs: pending work, retries, marks, profile history, vocabulary changes. Every fold is one grouping of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import backoff_hours
from .counts import concordance
from .joins import during

MOST_ATTEMPTS = 5


def available(items: DataFrame, errors: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Items (article_id) without an error that was given up or waits for its next try, and without a live claim."""
    waiting = errors.filter((F.col("attempts") >= MOST_ATTEMPTS) | (F.col("next_retry_at") > now)).select("article_id")
    return items.join(waiting, "article_id", "left_anti").join(claims.filter(F.col("until") > now).select("article_id"), "article_id", "left_anti")


def pending(articles: DataFrame, made: DataFrame, needs: list[DataFrame], errors: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Articles that lack a stage's artifact, have what the stage needs, and are available."""
    rows = articles.join(made.select("article_id").distinct(), "article_id", "left_anti")
    for need in needs:
        rows = rows.join(need.select("article_id").distinct(), "article_id", "left_semi")
    return available(rows, errors, claims, now)


def retries(outcomes: DataFrame) -> DataFrame:
    """(item_id, attempts, next_retry_at) after a log of outcomes (item_id, event_id, at, failed, permanent): a success clears, a failure adds an attempt, a permanent one counts as
    all, the next try is put off by the attempts. Items whose last outcome is a success are left out. Only the failures since the last success matter, so
    nothing is gathered: they are counted behind it."""
    by = Window.partitionBy("item_id")
    cleared = F.max(F.when(~F.col("failed"), F.struct("at", "event_id"))).over(by)
    rows = outcomes.withColumn("_cleared", cleared).filter("failed").filter(F.col("_cleared").isNull() | (F.struct("at", "event_id") > F.col("_cleared")))
    out = rows.groupBy("item_id").agg(F.least(F.count("*"), F.lit(MOST_ATTEMPTS)).alias("_n"), F.max(F.col("permanent")).alias("_p"), F.max("at").cast("timestamp").alias("_at"))
    attempts = F.when(F.col("_p"), MOST_ATTEMPTS).otherwise(F.col("_n")).cast("int")
    later = F.timestamp_add("HOUR", backoff_hours(F.col("attempts")), F.col("_at"))
    return out.withColumn("attempts", attempts).select("item_id", "attempts", F.when(F.col("attempts") < MOST_ATTEMPTS, later).alias("next_retry_at"))


def marks(log: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    """(user_id, article_id, stars, read_at, bookmarked_at) of a log (user_id, article_id, event_id, ts, action, stars): the latest rating holds and 0 deletes it; the first
    reading and bookmark since the last undoing hold. Undoing a reading brings the story back, so it clears the readings of all its articles (stories: article_id, story_id;
    without, each article is its own)."""
    when = lambda a: F.when(F.col("action") == a, F.struct("ts", "event_id"))
    by = Window.partitionBy("user_id", "article_id")
    story = F.coalesce("story_id", "article_id") if stories is not None else F.col("article_id")
    log = (log.join(stories.select("article_id", "story_id"), "article_id", "left") if stories is not None else log).withColumn("_story", story)
    rows = log.withColumn("_unread", F.max(when("unread")).over(Window.partitionBy("user_id", "_story"))).withColumn("_unmark", F.max(when("unbookmark")).over(by))
    since = lambda a, undo: F.min(F.when((F.col("action") == a) & (F.col(undo).isNull() | (F.struct("ts", "event_id") > F.col(undo))), F.col("ts")))
    stars = F.max_by("stars", when("rate"))
    out = rows.groupBy("user_id", "article_id").agg(stars.alias("stars"), since("read", "_unread").alias("read_at"), since("bookmark", "_unmark").alias("bookmarked_at"))
    return out.withColumn("stars", F.when(F.col("stars") > 0, F.col("stars")))


def cascade(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi")


def appended(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The fresh rows whose key isn't stored yet, one of each; nulls are equal."""
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    once = fresh.dropDuplicates(key)
    return once.alias("f").join(stored.select(*key).alias("s"), condition, "left_anti")


def history(changes: DataFrame) -> DataFrame:
    """Versions (user_id, version, hash, created_at, retired_at, change_id) of a log (user_id, change_id, at, hash): a change to the same hash is none, time never runs backwards, each version
    retires at the next one."""
    by = Window.partitionBy("user_id").orderBy("change_id")
    rows = changes.withColumn("created_at", F.max("at").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.lag("hash").over(by))
    kept = rows.filter(~F.col("hash").eqNullSafe(F.col("_before")))
    return kept.select("user_id", F.row_number().over(by).cast("bigint").alias("version"), "hash", "created_at", F.lead("created_at").over(by).alias("retired_at"), "change_id")


def frozen(history: DataFrame, ratings: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """history with rated and concordance of each retired version, as they stood when it retired: of the ratings (log: user_id, article_id, event_id, ts, stars) that were made while it was
    in use, the last one of each article, less the articles that it rests on (evidence: user_id, version, article_id) and those without a score (user_id, article_id, score). Versions in use
    have none yet. Each rating meets one version."""
    by = ["user_id", "version"]
    then = during(ratings.select("user_id", "article_id", "event_id", "ts", "stars"), history.filter("retired_at is not null"), ["user_id"], "ts", evidence)
    known = then.groupBy(*by, "article_id").agg(F.max_by("stars", F.struct("ts", "event_id")).alias("stars")).join(scores, ["user_id", "article_id"])
    stats = known.groupBy(*by).agg(F.count("*").alias("rated")).join(concordance(known, by), by, "left")
    out = history.join(stats, by, "left")
    return out.withColumn("rated", F.when(F.col("retired_at").isNotNull(), F.coalesce("rated", F.lit(0))))


def suggestions(log: DataFrame, versions: DataFrame) -> DataFrame:
    """(suggestion_id, status) of a log (user_id, suggestion_id, event_id, action): what was decided first holds; an open one is superseded when a later one was made, or the
    user's profile got a new version since (user_id, change_id)."""
    made = log.filter("action = 'made'").select("user_id", "suggestion_id", F.col("event_id").alias("_made"))
    current = versions.groupBy("user_id").agg(F.max("change_id").alias("_changed"))
    decided = log.filter("action <> 'made'").groupBy("suggestion_id").agg(F.min_by("action", "event_id").alias("_action"))
    last = F.max("_made").over(Window.partitionBy("user_id"))
    rows = made.withColumn("_last", last).join(decided, "suggestion_id", "left").join(current, "user_id", "left")
    moved = (F.col("_made") < F.col("_last")) | F.coalesce(F.col("_made") < F.col("_changed"), F.lit(False))
    return rows.select("suggestion_id", F.coalesce("_action", F.when(moved, "superseded"), F.lit("pending")).alias("status"))


def merge_topics(tags: DataFrame, aliases: DataFrame, vocabulary: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tags (artifact_id, topic), aliases (alias, name) and vocabulary (name, facet) after merges (source, target), which were validated: tags and aliases move to the
    target, one tag where both stood, the source becomes an alias and leaves the vocabulary."""
    to = merges.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    moved = tags.join(to, F.col("topic") == F.col("_s"), "left").select("artifact_id", F.coalesce("_t", "topic").alias("topic")).distinct()
    pointed = aliases.join(to, F.col("name") == F.col("_s"), "left").select("alias", F.coalesce("_t", "name").alias("name")).unionByName(merges.select(F.col("source").alias("alias"), F.col("target").alias("name")))
    return moved, pointed, vocabulary.join(merges.select(F.col("source").alias("name")), "name", "left_anti")


def replace_vocabulary(vocabulary: DataFrame, wanted: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (name, facet) after a replacement, and the topics that can't go as they are in use (then nothing may be replaced)."""
    gone = vocabulary.join(wanted.select("name"), "name", "left_anti")
    blocked = gone.join(tags.select(F.col("topic").alias("name")), "name", "left_semi").select("name")
    return wanted.select("name", "facet"), blocked


def link_tags(names: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """(artifact_id, name, topic): each name by the vocabulary, else by an alias; null if neither knows it, which rejects the artifact."""
    own = vocabulary.select("name", F.col("name").alias("_own"))
    by_alias = aliases.select(F.col("alias").alias("name"), F.col("name").alias("_alias"))
    return names.join(own, "name", "left").join(by_alias, "name", "left").select("artifact_id", "name", F.coalesce("_own", "_alias").alias("topic"))


def glossary_upsert(terms: DataFrame, sources: DataFrame, fresh: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Glossary sources (source, term_id, added_at) after an upsert of fresh terms (term_id, target, abbr, sources array) into terms (term_id, target, abbr), and the rejected ones
    (term_id, reasons). A term is rejected if its target, its abbreviation or one of its sources, whatever its case, is that of another term, stored or fresh with a smaller
    id. A term's spelling that stays keeps its time, what it no longer names goes, the rest is new, a change of case included."""
    others = terms.join(fresh.select("term_id"), "term_id", "left_anti")

    def taken(kind: str, stored: DataFrame, given: DataFrame) -> DataFrame:
        """(term_id, reason) of the fresh terms whose value (term_id, v) another one has."""
        all_ = stored.select("v", F.lit(None).cast(given.schema["term_id"].dataType).alias("_by")).unionByName(given.select("v", F.col("term_id").alias("_by")))
        owner = all_.groupBy("v").agg(F.max(F.col("_by").isNull()).alias("_stored"), F.min("_by").alias("_first"))
        return given.join(owner, "v").filter(F.col("_stored") | (F.col("_first") < F.col("term_id"))).select("term_id", F.lit(kind).alias("reason")).distinct()

    listed = fresh.select("term_id", F.explode(F.array_distinct("sources")).alias("source"))
    kept = sources.join(fresh.select("term_id"), "term_id", "left_anti")
    value = lambda df, c: df.filter(F.col(c).isNotNull()).select("term_id", F.col(c).alias("v"))
    low = lambda df: df.select("term_id", F.lower("source").alias("v")).distinct()
    bad = taken("target", value(others, "target"), value(fresh, "target")).unionByName(taken("abbr", value(others, "abbr"), value(fresh, "abbr"))).unionByName(taken("source", low(kept), low(listed)))
    rejected = bad.groupBy("term_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    good = listed.join(rejected.select("term_id"), "term_id", "left_anti").join(sources.withColumnRenamed("added_at", "_was"), ["term_id", "source"], "left")
    untouched = sources.join(fresh.join(rejected.select("term_id"), "term_id", "left_anti").select("term_id"), "term_id", "left_anti")
    return untouched.select("source", "term_id", "added_at").unionByName(good.select("source", "term_id", F.coalesce("_was", now).alias("added_at"))), rejected


def requests_done(requests: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation requests (article_id, user_id, asked_at) with done_at: at once if the translation was there, else when it is made."""
    first = translations.groupBy("article_id").agg(F.min("created_at").alias("_made"))
    return requests.join(first, "article_id", "left").withColumn("done_at", F.greatest("asked_at", "_made")).withColumn("done_at", F.when(F.col("_made").isNotNull(), F.col("done_at"))).drop("_made")


def redo(articles: DataFrame, made: DataFrame, model: str, condition: Column) -> DataFrame:
    """Articles that meet a condition and have no artifact of the model."""
    return articles.filter(condition).join(made.filter(F.col("model") == model).select("article_id"), "article_id", "left_anti")


def stale_by_glossary(artifacts: DataFrame, hits: DataFrame, glossary: DataFrame) -> DataFrame:
    """Latest artifacts (article_id, made_at) made before the newest change of a term that their text mentions (hits: article_id, term_id)."""
    newest = hits.join(glossary.select("term_id", "changed_at"), "term_id").groupBy("article_id").agg(F.max("changed_at").alias("_changed"))
    return artifacts.join(newest, "article_id").filter(F.col("made_at").isNull() | (F.col("_changed") > F.col("made_at"))).drop("_changed")
