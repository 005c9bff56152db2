"""Filters: relevance of candidates, entitlement, list conditions, crawl rules, validation with reasons."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex
from ..functions.time import effective


def backlog(articles: DataFrame, since: datetime | Column) -> DataFrame:
    """Articles, with their effective time, that count as out since then."""
    at = effective(F.col("published_at"), F.col("fetched_at"))
    return articles.withColumn("at", at).filter(F.col("at") >= (since if isinstance(since, Column) else F.lit(since)))


def relevant(candidates: DataFrame, filters: DataFrame) -> DataFrame:
    """Candidates (source_id, title, url, summary) that pass their source's filter (source_id, keywords, url_contains, title_excludes): an excluded word in the title decides; without keywords and URL parts all pass, else one has to be there."""
    has = lambda text, words: F.exists(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: F.contains(text, w))
    free = (F.coalesce(F.size("keywords"), F.lit(0)) <= 0) & (F.coalesce(F.size("url_contains"), F.lit(0)) <= 0)
    words = has(F.col("title"), "keywords") | F.coalesce(has(F.col("summary"), "keywords"), F.lit(False))
    joined = candidates.join(filters, "source_id", "left")
    return joined.filter(~has(F.col("title"), "title_excludes") & (free | words | has(F.col("url"), "url_contains"))).select(candidates.columns)


def missing(pairs: DataFrame, required: DataFrame, owned: DataFrame) -> DataFrame:
    """(user_id, artifact_id, membership_id) that a user lacks for an artifact, of the given pairs."""
    return pairs.select("user_id", "artifact_id").join(required, "artifact_id").join(owned, ["user_id", "membership_id"], "left_anti")


def viewable(pairs: DataFrame, required: DataFrame, owned: DataFrame) -> DataFrame:
    """The pairs (user_id, artifact_id, ...) for which the user owns every membership that the artifact requires."""
    return pairs.join(missing(pairs, required, owned).select("user_id", "artifact_id").distinct(), ["user_id", "artifact_id"], "left_anti")


def scope(artifacts: DataFrame, required: DataFrame) -> DataFrame:
    """Each artifact's required memberships, sorted and joined by +, or public."""
    codes = required.groupBy("artifact_id").agg(F.concat_ws("+", F.sort_array(F.collect_set("code"))).alias("scope"))
    return artifacts.join(codes, "artifact_id", "left").withColumn("scope", F.coalesce("scope", F.lit("public")))


def locked_by(articles: DataFrame, required: DataFrame, owned: DataFrame) -> DataFrame:
    """(user_id, article_id, locks): the sorted names of what each user lacks for each article of the pairs."""
    lack = articles.join(required, "article_id").join(owned, ["user_id", "membership_id"], "left_anti")
    return lack.groupBy("user_id", "article_id").agg(F.sort_array(F.collect_set("name")).alias("locks"))


def visible(min_score: int | None, show_all: bool = False) -> Column:
    """What lists show: relevant articles at or above the least score; unscored ones only while there is none."""
    if show_all:
        return F.lit(True)
    return F.col("relevant") & (F.lit(True) if min_score is None else F.coalesce(F.col("score") >= min_score, F.lit(False)))


def rated(kind: str, at_least: int | None = None) -> Column:
    """any, hide_low (unrated or above two stars), at_least(n) or unrated."""
    stars = F.col("stars")
    return {"any": F.lit(True), "hide_low": stars.isNull() | (stars > 2), "at_least": F.coalesce(stars >= (at_least or 1), F.lit(False)), "unrated": stars.isNull()}[kind]


def marked(column: str, wanted: bool | None, story_column: str | None = None) -> Column:
    """Marked, unmarked or either (None); a mark on any article of the story counts where its column is named."""
    mark = F.coalesce(F.col(column), F.col(story_column)) if story_column else F.col(column)
    return F.lit(True) if wanted is None else mark.isNotNull() if wanted else mark.isNull()


@dataclass
class Conditions:
    """A search request; what is absent doesn't filter, and neither does a least score of 0."""

    topics: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    lang: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    at_least: int | None = None
    unrated: bool = False
    min_score: int | None = None

    def column(self) -> Column:
        """The rows (topics, source_id, lang, at, stars, score) that meet all conditions."""
        if self.unrated and self.at_least is not None:
            raise ValueError("unrated articles have no stars")
        out = F.lit(True)
        for t in self.topics:
            out &= F.array_contains("topics", t)
        if self.sources:
            out &= F.col("source_id").isin(self.sources)
        if self.lang:
            out &= F.col("lang") == self.lang
        if self.since is not None:
            out &= F.col("at") >= F.lit(self.since)
        if self.until is not None:
            out &= F.col("at") < F.lit(self.until)
        if self.unrated or self.at_least is not None:
            out &= rated("unrated" if self.unrated else "at_least", self.at_least)
        if self.min_score:
            out &= F.coalesce(F.col("score") >= self.min_score, F.lit(False))
        return out


def crawlable(urls: DataFrame, rules: DataFrame, product: str) -> DataFrame:
    """urls (origin, path, ...) with allowed, by rules (origin, agent, pattern, allow): the product's group of an origin where there is one, else that
    of *; the longest matching pattern decides, allow on a tie, and without a match all is allowed."""
    own = rules.filter(F.lower("agent") == product.lower())
    others = rules.filter(F.col("agent") == "*").join(own.select("origin").distinct(), "origin", "left_anti")
    group = own.unionByName(others).filter(F.col("pattern") != "").select("origin", "pattern", "allow", glob_to_regex(F.col("pattern")).alias("regex"))
    hit = urls.join(group, "origin").filter(F.regexp_like("path", F.col("regex")))
    verdict = hit.groupBy("origin", "path").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allowed"))
    return urls.join(verdict, ["origin", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def visit_split(fetched: Column, boundary: Column) -> Column:
    """new or earlier: what came after the last visit; all is new on a first one."""
    return F.when(boundary.isNull() | (fetched > boundary), "new").otherwise("earlier")


def rejected_records(records: DataFrame, required: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, reasons) of records (position, id, topics, new_topics): not asked for, repeated, not one to five topics, repeated or unknown topics, more
    than one new topic, or one of over 20 characters or with control characters; and of required ids without a record."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    seen = records.withColumn("turn", first).join(required.select("id", F.lit(True).alias("asked")), "id", "left")
    unknown = records.select("position", F.explode("topics").alias("name")).join(vocabulary.select("name"), "name", "left_anti").groupBy("position").agg(F.count("*").alias("unknown"))
    seen = seen.join(unknown, "position", "left")
    bad_new = F.exists("new_topics", lambda t: (F.length(t) > 20) | (F.length(t) == 0) | t.rlike(r"[\x00-\x1f\x7f]"))
    rules = [
        (F.col("asked").isNull(), "not required"), (F.col("turn") > 1, "repeated"), ((F.size("topics") < 1) | (F.size("topics") > 5), "number of topics"),
        (F.size(F.array_distinct("topics")) < F.size("topics"), "repeated topic"), (F.col("unknown").isNotNull(), "unknown topic"), (F.size("new_topics") > 1, "new topics"), (bad_new, "new topic name"),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))
    bad = seen.select("id", reasons.alias("reasons")).filter(F.size("reasons") > 0)
    absent = required.select("id").join(records.select("id"), "id", "left_anti").select("id", F.array(F.lit("missing")).alias("reasons"))
    return bad.unionByName(absent)


def profile_faults(profiles: DataFrame, most: int = 50, longest: int = 50) -> DataFrame:
    """(user_id, reasons) of profiles (user_id, interests array of (topic, weight), excludes array) that aren't valid."""
    topics = F.transform("interests", lambda i: F.trim(i["topic"]))
    rules = [
        ((F.size("interests") > most) | (F.size("excludes") > most), "too many"), (F.exists(F.concat(topics, "excludes"), lambda t: (F.length(t) > longest) | t.rlike(r"[\x00-\x1f\x7f]")), "text"),
        (F.exists(topics, lambda t: t == ""), "blank topic"), (F.size(F.array_distinct(topics)) < F.size(topics), "repeated topic"),
        (F.exists("interests", lambda i: (i["weight"] < 0) | (i["weight"] > 1)), "weight"), (~F.exists("interests", lambda i: i["weight"] > 0), "no positive weight"),
    ]
    return profiles.select("user_id", F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules))).alias("reasons")).filter(F.size("reasons") > 0)


def valid_merges(proposals: DataFrame, vocabulary: DataFrame, curated: list[str]) -> DataFrame:
    """Merge proposals (position, source, target) that hold: both known, not the same, of one facet, no curated source; the first for each source,
    and no target that is itself merged."""
    names = lambda c: vocabulary.select(F.col("name").alias(c), F.col("facet").alias(f"{c}_facet"))
    known = proposals.join(names("source"), "source").join(names("target"), "target").filter((F.col("source") != F.col("target")) & (F.col("source_facet") == F.col("target_facet")) & ~F.col("source").isin(curated))
    first = known.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("position"))).filter("turn = 1")
    chained = first.select(F.col("source").alias("target"))
    return first.join(chained, "target", "left_anti").select("position", "source", "target")
