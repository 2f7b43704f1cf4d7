"""Text search, tagging, ranking of hits and the documents they are searched in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.exprs import as_double, number_text
from auditlake.functions.substrings import MOST_CHARACTERS, occurrences
from auditlake.functions.text import contains_any, hit_count
from auditlake.session import materialize

# Stop words of the two keyword extractors.
QUERY_STOP_WORDS = [
    "show", "me", "the", "all", "get", "find", "list", "what", "which", "how", "many", "from", "with", "and", "or",
    "of", "in", "on", "at", "to", "for", "by",
]
TEXT_STOP_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# Weights and limits of the rankings.
NAME_BOOST, TAG_BOOST, TYPE_BOOST = 0.3, 0.2, 0.1
TYPE_WORDS = ["number", "text", "date", "time"]
DISTANCE_LIMIT = 0.8
ROLLUP_WEIGHTS = {"table": 1.0}
ROLLUP_REST = 0.7
WORD_NAME, WORD_DESCRIPTION, WORD_COLUMN, WORD_TAG = 0.5, 0.3, 0.2, 0.1
ENTITY_NAME, ENTITY_COLUMN, ENTITY_DESCRIPTION, ATTRIBUTE_COLUMN, ENTITY_BONUS = 0.4, 0.2, 0.2, 0.1, 0.3
BONUS_ENTITIES = ["customer", "product", "order", "employee", "payment"]
SELECT_ABOVE, SELECT_REST, CONFIDENCE_CAP = 0.3, 3, 0.8
MENTION_LIMIT, INDEX_LIMIT, INDEX_MIN = 3, 10, 1
CONTAINED_FROM = 4  # fixed value: letters of a name that may be part of another


def contains_search(df: DataFrame, fields: list[str], q: str, key: str, any_word: bool = False) -> DataFrame:
    """One row per (item, field) whose text holds the query, or any of its words; one pass."""
    words = q.lower().split() if any_word else [q.lower()]
    lows = df.select(
        key, *[F.col(f).cast("string").alias(f) for f in fields], *[F.lower(F.col(f).cast("string")).alias(f"_low_{f}") for f in fields]
    )
    hits = [
        F.when(
            contains_any(F.col(f"_low_{f}"), words),
            F.struct(F.lit(f).alias("field"), F.col(f).alias("value")),
        )
        for f in fields
    ]
    return lows.select(key, F.inline(F.array(*hits))).filter(F.col("field").isNotNull())


def query_keywords(text: Column, stop: list[str] = QUERY_STOP_WORDS, n: int = 5) -> Column:
    """First n words of more than two letters that are no stop words."""
    words = F.split(F.lower(text), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop)), 1, n)


def text_keywords(text: Column, stop: list[str] = TEXT_STOP_WORDS, min_length: int = 3) -> Column:
    """Distinct purely alphabetic words of a text, sorted."""
    words = F.split(F.lower(text), r"[_\s\-\.]")
    good = lambda w: (F.length(w) >= min_length) & ~w.isin(stop) & w.rlike(r"^\p{L}+$")
    # Repeats go first: the checks then run once per distinct word.
    return F.array_sort(F.filter(F.array_distinct(words), good))


def keywords(df: DataFrame, text: str, key: str, mode: str = "query", n: int = 5) -> DataFrame:
    words = query_keywords(F.col(text), n=n) if mode == "query" else text_keywords(F.col(text))
    return df.select(key, words.alias("keywords"))


def tag(df: DataFrame, text: str, dictionary: dict[str, list[str]]) -> DataFrame:
    """Adds the concepts of which the text holds a keyword. No join: the dictionary is in the plan."""
    lowered = df.withColumn("_low", F.lower(F.col(text)))
    marks = [F.when(contains_any(F.col("_low"), words), F.lit(name)) for name, words in dictionary.items()]
    return lowered.withColumn("tags", F.array_compact(F.array(*marks))).drop("_low")


def merge_hits(*hits: DataFrame, key: str = "id") -> DataFrame:
    """All hits, each key once, from the first search that found it (then its nearest)."""
    rest = [c for c in hits[0].columns if c != key]
    ranked = [h.withColumn("strategy", F.lit(i)) for i, h in enumerate(hits)]
    best = (
        reduce(DataFrame.unionByName, ranked)
        .groupBy(key)
        .agg(F.min(F.struct("strategy", *rest)).alias("_b"))
    )
    return best.select(key, "_b.*")


def rank_hits(hits: DataFrame, query: str, limit: int, key: str = "id") -> DataFrame:
    """Relevance of hits (id, name, tags, data_type, distance) with boosts for words of the query."""
    low = F.lit(query.lower())
    score = F.greatest(F.lit(0.0), 1.0 - F.col("distance"))
    score = score + F.when(low.contains(F.lower("name")), NAME_BOOST).otherwise(0.0)
    score = score + TAG_BOOST * F.size(F.filter("tags", lambda t: low.contains(F.lower(t))))
    if any(w in query.lower() for w in TYPE_WORDS):
        score = score + F.when(F.coalesce(F.length("data_type"), F.lit(0)) > 0, TYPE_BOOST).otherwise(0.0)
    return (
        hits.filter(F.col("distance") <= DISTANCE_LIMIT)
        .withColumn("relevance", as_double(F.least(F.lit(1.0), score)))
        .orderBy(F.desc("relevance"), key)
        .limit(limit)
    )


def rollup_hits(hits: DataFrame, parent: str, kind: str, score: str, n: int) -> DataFrame:
    """Best weighted score per parent, top n."""
    weight = F.lit(ROLLUP_REST)
    for name, w in ROLLUP_WEIGHTS.items():
        weight = F.when(F.col(kind) == name, w).otherwise(weight)
    return (
        hits.groupBy(parent)
        .agg(as_double(F.max(F.col(score) * weight)).alias("score"))
        .orderBy(F.desc("score"), parent)
        .limit(n)
    )


def lexical_score(df: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """Word matches in name, description, columns (array) and tags (array); capped at 1."""
    words = query.lower().split()
    name, description = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    score = WORD_NAME * hit_count(name, words) + WORD_DESCRIPTION * hit_count(description, words)
    for w in words:
        score = score + WORD_COLUMN * F.size(F.filter("columns", lambda c: F.lower(c).contains(w)))
    score = score + WORD_TAG * F.size(F.filter("tags", lambda t: contains_any(t, words)))
    return (
        df.withColumn("score", as_double(F.least(score, F.lit(1.0))))
        .filter(F.col("score") > 0)
        .orderBy(F.desc("score"), key)
        .limit(limit)
        .select(key, "name", "score")
    )


def concept_scores(df: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """Relevance of items (name, description, columns) to entities and attributes."""
    name, description = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    in_columns = lambda word: F.exists("columns", lambda c: F.lower(c).contains(word))
    score = F.lit(0.0)
    for e in concepts.get("entities", []):
        score = score + F.when(name.contains(e), ENTITY_NAME).when(in_columns(e), ENTITY_COLUMN).otherwise(0.0)
        score = score + F.when(description.contains(e), ENTITY_DESCRIPTION).otherwise(0.0)
        if e in BONUS_ENTITIES:
            score = score + F.when(name.contains(e), ENTITY_BONUS).otherwise(0.0)
    for a in concepts.get("attributes", []):
        score = score + ATTRIBUTE_COLUMN * F.size(F.filter("columns", lambda c: F.lower(c).contains(a)))
    return df.withColumn("score", as_double(F.least(score, F.lit(1.0))))


def concept_select(df: DataFrame, concepts: dict[str, list[str]], key: str) -> DataFrame:
    """Items above the threshold, else the best three; with the confidence of the choice."""
    # Read four times below: the table is scanned once, for the items that score at all.
    scored = materialize(concept_scores(df, concepts).filter(F.col("score") > 0).select(key, "name", "score"))
    above = scored.filter(F.col("score") > SELECT_ABOVE)
    some = scored.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("m")).scalar() > SELECT_ABOVE
    rest = scored.orderBy(F.desc("score"), key).limit(SELECT_REST).filter(~some)
    chosen = above.unionByName(rest)
    mean = chosen.agg((F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("m")).scalar()
    return chosen.withColumn("confidence", as_double(F.least(F.lit(CONFIDENCE_CAP), mean)))


def match_names(
    left: DataFrame, name: str, right: DataFrame, other: str, ordinal: str, most: int = MOST_CHARACTERS
) -> DataFrame:
    """The known name for each given one: the exact one, else the first (by ordinal) that
    is equal but for case or contains the other, when the contained one has over 3 letters."""
    given = left.select(F.col(name).alias("given")).distinct()
    known = right.select(F.col(other).alias("known"), F.col(ordinal).alias("_ord"))
    exact = given.join(
        known.groupBy("known").agg(F.min("_ord").alias("_ord")), F.col("given") == F.col("known")
    ).select("given", "known", F.lit("exact").alias("match"))

    open_names = given.join(exact.select("given"), "given", "left_anti").select("given", F.lower("given").alias("_l"))
    lows = open_names.select("_l").distinct()
    first = known.groupBy(F.lower("known").alias("_r")).agg(F.min(F.struct("_ord", "known")).alias("_first"))
    texts = first.select("_r")
    equal = lows.join(texts, F.col("_l") == F.col("_r")).select("_l", "_r")
    long = lambda df, c: df.filter(F.length(c) >= CONTAINED_FROM).withColumn("_p", F.col(c))
    # Pairs stream into the minimum; they are never collected or made distinct.
    pairs = equal.unionByName(occurrences(texts, ["_r"], "_r", long(lows, "_l"), "_l", "_p", most=most)).unionByName(
        occurrences(lows, ["_l"], "_l", long(texts, "_r"), "_r", "_p", most=most)
    )
    best = pairs.join(first, "_r").groupBy("_l").agg(F.min("_first").alias("_first"))
    loose = open_names.join(best, "_l").select(
        "given",
        F.col("_first.known").alias("known"),
        F.when(F.lower("_first.known") == F.col("_l"), "case").otherwise("partial").alias("match"),
    )
    return exact.unionByName(loose)


def corpus_stats(df: DataFrame, group: str, kind: str, tags: str) -> DataFrame:
    """Documents, distinct groups and tags, and documents per kind; one row per figure."""
    row = df.agg(F.count("*").alias("documents"), F.countDistinct(group).alias("groups"))
    figures = row.select(
        F.inline(
            F.array(
                F.struct(F.lit("documents").alias("figure"), F.col("documents").alias("value")),
                F.struct(F.lit("groups").alias("figure"), F.col("groups").alias("value")),
            )
        )
    )
    kinds = df.groupBy(F.concat(F.lit("kind:"), F.col(kind)).alias("figure")).agg(F.count("*").alias("value"))
    names = df.select(F.explode(tags).alias("_t")).agg(F.countDistinct("_t").alias("value"))
    return figures.unionByName(kinds).unionByName(names.select(F.lit("tags").alias("figure"), "value"))


# What makes a column name a key column, and how many are listed.
KEY_WORDS = ["id", "key", "name", "email"]
KEY_LIMIT = 5


def build_documents(profile: DataFrame) -> DataFrame:
    """One text per table and one per column, from profile rows (table_name, column_name, ...)."""
    is_key = contains_any(F.lower("column_name"), KEY_WORDS)
    # As many rows per table as it has columns.
    tables = profile.groupBy("table_name").agg(
        F.count("*").alias("_n"),
        F.max("total_count").alias("_rows"),
        F.slice(F.array_sort(F.collect_list(F.when(is_key, F.col("column_name")))), 1, KEY_LIMIT).alias("_keys"),
    )
    entity = tables.select(
        "table_name",
        F.lit(None).cast("string").alias("column_name"),
        F.lit("table").alias("kind"),
        F.concat_ws(
            " | ",
            F.concat(F.lit("Table: "), "table_name"),
            F.concat(F.lit("Columns: "), F.col("_n").cast("string")),
            F.when(F.size("_keys") > 0, F.concat(F.lit("Key columns: "), F.array_join("_keys", ", "))),
            F.when(F.col("_rows") > 0, F.concat(F.lit("Contains "), F.col("_rows").cast("string"), F.lit(" records"))),
        ).alias("content"),
    )
    child = profile.select(
        "table_name",
        "column_name",
        F.lit("column").alias("kind"),
        F.concat_ws(
            " | ",
            F.concat(F.lit("Column: "), "table_name", F.lit("."), "column_name"),
            F.concat(F.lit("Type: "), "data_type"),
            F.concat(F.lit("Distinct: "), F.col("distinct_count").cast("string")),
            F.when(F.size("sample_values") > 0, F.concat(F.lit("Examples: "), F.array_join("sample_values", ", "))),
        ).alias("content"),
    )
    return entity.unionByName(child)


def hits_by_parent(hits: DataFrame, keep: DataFrame, parent: str, key: str, score: str) -> DataFrame:
    """The hits of the kept parents as one ordered list each. ``hits`` is a top-k result."""
    kept = hits.join(keep.select(parent).distinct(), parent, "left_semi")
    return kept.groupBy(parent).agg(
        F.count("*").alias("hits"),
        F.transform(F.array_sort(F.collect_list(F.struct(score, key))), lambda e: e[key]).alias("items"),
    )


def link_summary(edges: DataFrame, keep: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """Per source its targets, among edges with both ends in the kept set; with totals."""
    wanted = keep.select(F.col(name)).distinct()
    inside = edges.join(wanted, F.col(source) == F.col(name), "left_semi").join(
        wanted, F.col(target) == F.col(name), "left_semi"
    )
    # Links between tables, not rows: as many as the schema has.
    per_source = inside.groupBy(source).agg(
        F.array_sort(F.collect_set(target)).alias("targets"), F.count("*").alias("links")
    )
    totals = per_source.agg(F.struct(F.count("*").alias("c"), F.sum("links").alias("n"))).scalar()
    return per_source.select(
        source, "targets", "links", totals["c"].alias("connected"), totals["n"].alias("total_links")
    )


def mentions(
    texts: DataFrame, key: str, text: str, names: DataFrame, name: str, n: int = MENTION_LIMIT, most: int = MOST_CHARACTERS
) -> DataFrame:
    """The first n names (in order) that occur in each text, ignoring case.

    All names are looked for at once while the texts are read; a task passes on n
    names per text. Texts with the same key count as one.
    """
    wanted = names.select(F.col(name).alias("name")).distinct().withColumn("_l", F.lower("name"))
    bodies = texts.select(key, F.lower(F.col(text)).alias("_text"))
    pairs = occurrences(bodies, [key], "_text", wanted, "name", "_l", n, most).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("name"))
    top = pairs.withColumn("place", place).filter(F.col("place") <= n)
    return top.select(key, "name", F.col("place").cast("bigint").alias("place"))


def tag_index(tagged: DataFrame, key: str, min_n: int = INDEX_MIN, cap: int = INDEX_LIMIT) -> DataFrame:
    """Per tag the number of members and its first ``cap``; tags with more than ``min_n`` only."""
    pairs = tagged.select(F.explode("tags").alias("tag"), F.col(key).alias("_m")).distinct()
    sizes = pairs.groupBy("tag").agg(F.count("*").alias("members")).filter(F.col("members") > min_n)
    place = F.row_number().over(Window.partitionBy("tag").orderBy("_m"))
    first = pairs.withColumn("_p", place).filter(F.col("_p") <= cap)
    listed = first.groupBy("tag").agg(F.array_sort(F.collect_list("_m")).alias("listed"))
    return sizes.join(listed, "tag")


def shared_tags(edges: DataFrame, tagged: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Edges whose two ends have tags in common."""
    marks = tagged.select(F.col(key).alias("_k"), "tags")
    a = marks.select(F.col("_k").alias(source), F.col("tags").alias("_a"))
    b = marks.select(F.col("_k").alias(target), F.col("tags").alias("_b"))
    both = edges.join(a, source).join(b, target)
    common = both.withColumn("shared", F.array_sort(F.array_intersect("_a", "_b"))).drop("_a", "_b")
    return common.filter(F.size("shared") > 0)


def enriched_profile(profile: DataFrame, documents: DataFrame) -> DataFrame:
    """Column statistics as text, next to the column's document; figures that are null are left out."""
    fact = lambda label, c: F.concat(F.lit(f"{label}="), F.col(c).cast("string"))
    facts = F.concat_ws(
        "; ",
        fact("total", "total_count"),
        fact("distinct", "distinct_count"),
        fact("nulls", "null_count"),
        fact("min", "min_value"),
        fact("max", "max_value"),
        F.concat(F.lit("avg="), number_text(F.round("avg_value", 6), T.DoubleType())),
    )
    texts = documents.filter(F.col("kind") == "column").select("table_name", "column_name", "content")
    return profile.withColumn("facts", facts).join(texts, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", "facts", "content"
    )
