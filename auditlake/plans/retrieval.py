"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.inverted import ROUNDS
from auditlake.operators import profile as pr
from auditlake.operators import relate
from auditlake.operators import retrieve as v
from auditlake.operators import search as s
from auditlake.operators.inventory import table_inventory
from auditlake.plans import Registry
from auditlake.plans.profiles import CUSTOMER, ORDERS
from auditlake.plans.relations import DISCOVERED, KEYS, tables as key_tables
from auditlake.plans.shapes import mean
from auditlake.session import materialize
from auditlake.sources.tables import load

REG = Registry()

DIMS = 64


def _first_vector(spark, d):
    return load(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()["embedding"]


def cosine_sql(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"round(1.0 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
HITS = f"SELECT vec_id, label, {cosine_sql('embedding', QUERY)} AS distance FROM embeddings"


@REG.add("g1_knn", f"{HITS} ORDER BY distance, vec_id LIMIT 10")
def g1(spark, d):
    return v.knn(load(spark, d, "embeddings"), _first_vector(spark, d), 10)


@REG.add(
    "g1_knn_l2",
    f"""
    SELECT vec_id, label, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST({QUERY} AS DOUBLE[])),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance
    FROM embeddings ORDER BY distance, vec_id LIMIT 10
    """,
)
def g1_l2(spark, d):
    return v.knn(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "l2")


@REG.add(
    "g2_knn_filtered",
    f"SELECT * FROM ({HITS}) WHERE label IN (1, 2, 3) AND distance BETWEEN 0.7 AND 1.1 ORDER BY distance, vec_id LIMIT 20",
)
def g2(spark, d):
    return v.knn(
        load(spark, d, "embeddings"), _first_vector(spark, d), 20, min_d=0.7, max_d=1.1,
        filters=F.col("label").isin(1, 2, 3),
    )


@REG.add(
    "g2_fetch_group",
    "SELECT vec_id, label FROM embeddings WHERE label = 4",
)
def g2_group(spark, d):
    return load(spark, d, "embeddings").filter("label = 4").select("vec_id", "label")


CENTROIDS = f"""
    SELECT label, list(m ORDER BY i) AS center FROM (
        SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) / count(*) AS m
        FROM embeddings, range(1, {DIMS + 1}) t(i) GROUP BY label, i) GROUP BY label
"""


def _centroids(spark, d):
    """Mean vector per label: one query vector for each."""
    df = load(spark, d, "embeddings")
    parts = df.groupBy("label").agg(
        *[F.avg(F.col("embedding")[i].cast("double")).alias(f"_{i}") for i in range(DIMS)]
    )
    return parts.select("label", F.array(*[F.col(f"_{i}") for i in range(DIMS)]).alias("center"))


PLACED = "row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS place"


@REG.add(
    "g3_knn_join",
    f"""
    WITH c AS ({CENTROIDS}),
         p AS (SELECT CAST(c.label AS BIGINT) AS query_id, vec_id AS item_id,
                      {cosine_sql('center', 'embedding')} AS distance FROM c, embeddings)
    SELECT * FROM (SELECT *, {PLACED} FROM p) WHERE place <= 5
    """,
)
def g3(spark, d):
    return v.knn_join(_centroids(spark, d), load(spark, d, "embeddings"), 5, "label", "vec_id", "center")


def _lists_sql(rounds: int) -> str:
    """The inverted file for DuckDB: k-means over all rows, round by round, then each row's list."""
    unit = lambda v: f"list_transform(CAST({v} AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))))"
    home = lambda r: f"""
        a{r} AS MATERIALIZED (SELECT item_id, u, l FROM v, c{r} QUALIFY
            row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(u, c), 9) DESC, l) = 1)"""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id AS item_id, embedding, {unit('embedding')} AS u FROM embeddings)",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) AS l, u AS c FROM v
            QUALIFY l <= ceil(sqrt((SELECT count(*) FROM v))))""",
    ]
    for r in range(rounds):
        parts += [home(r), f"""
        m{r} AS (SELECT l, i, sum(u[i]) / count(*) AS m FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY l, i),
        c{r + 1} AS MATERIALIZED (SELECT l, coalesce(new.c, old.c) AS c FROM c{r} old LEFT JOIN (
            SELECT l, list(round(m / length, 6) ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY l)) AS length FROM m{r})
            GROUP BY l) new USING (l))"""]
    parts.append(home(rounds))
    return ", ".join(parts)


@REG.add(
    "g4_ann_join",
    f"""
    WITH q AS ({CENTROIDS}), {_lists_sql(ROUNDS)},
         o AS (SELECT CAST(label AS BIGINT) AS query_id, center, l, row_number() OVER (PARTITION BY label ORDER BY
                      round(list_dot_product(center, c) / sqrt(list_dot_product(center, center)), 9) DESC, l) AS rank FROM q, c{ROUNDS}),
         p AS (SELECT query_id, item_id, rank, {cosine_sql('center', 'embedding')} AS distance
               FROM o JOIN a{ROUNDS} USING (l) JOIN v USING (item_id)),
         t AS (SELECT rank, row_number() OVER (ORDER BY rank) AS n, count(*) OVER () AS many FROM (SELECT *, {PLACED} FROM p) WHERE place <= 5),
         f AS (SELECT max(rank) AS probes FROM t WHERE n = (95 * many + 99) // 100)
    SELECT * FROM (SELECT query_id, item_id, distance, {PLACED} FROM p WHERE rank <= (SELECT probes FROM f)) WHERE place <= 5
    """,
)
def g4(spark, d):
    return v.ann_join(_centroids(spark, d), load(spark, d, "embeddings"), 5, "label", "vec_id", DIMS, "center")


@REG.add(
    "g5_contains_search",
    """
    SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part WHERE contains(lower(p_name), 'ring')
    UNION ALL
    SELECT p_partkey, 'p_type', p_type FROM part WHERE contains(lower(p_type), 'ring')
    UNION ALL
    SELECT p_partkey, 'p_brand', p_brand FROM part WHERE contains(lower(p_brand), 'ring')
    """,
)
def g5(spark, d):
    return s.contains_search(load(spark, d, "part"), ["p_name", "p_type", "p_brand"], "Ring", "p_partkey")


@REG.add(
    "g5_any_word_search",
    " UNION ALL ".join(
        f"""SELECT p_partkey, '{c}' AS field, {c} AS value FROM part
            WHERE contains(lower({c}), 'small') OR contains(lower({c}), 'brand#2') OR contains(lower({c}), 'economy')"""
        for c in ["p_name", "p_type", "p_brand"]
    ),
)
def g5_any(spark, d):
    return s.contains_search(
        load(spark, d, "part"), ["p_name", "p_type", "p_brand"], "small Brand#2 economy", "p_partkey", any_word=True
    )


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


@REG.add(
    "g6_keywords_query",
    f"""
    SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(text), '\\s+'),
        lambda w: length(w) > 2 AND w NOT IN ({_quoted(s.QUERY_STOP_WORDS)})), 1, 5), ' ') AS keywords
    FROM documents
    """,
)
def g6(spark, d):
    out = s.keywords(load(spark, d, "documents"), "text", "doc_id")
    return out.withColumn("keywords", F.array_join("keywords", " "))


@REG.add(
    "g6_keywords_text",
    f"""
    SELECT doc_id, len(k) AS keyword_count, md5(array_to_string(k, ' ')) AS keywords_md5 FROM (
        SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[_\\s\\-\\.]'),
            lambda w: length(w) >= 3 AND w NOT IN ({_quoted(s.TEXT_STOP_WORDS)})
                AND regexp_matches(w, '^\\p{{L}}+$')))) AS k FROM documents)
    """,
)
def g6_text(spark, d):
    out = s.keywords(load(spark, d, "documents"), "text", "doc_id", "text")
    return out.select(
        "doc_id",
        F.size("keywords").cast("bigint").alias("keyword_count"),
        F.md5(F.array_join("keywords", " ")).alias("keywords_md5"),
    )


# Words that occur in the corpus.
DICTIONARY = {
    "pointing": ["this", "that", "these"],
    "linking": ["with", "from", "and"],
    "german": ["der", "und", "nicht"],
    "french": ["dans", "avec", "les"],
    "contact": ["@", "http"],
}


def tag_sql(text: str, dictionary=None) -> str:
    parts = []
    for name, words in (dictionary or DICTIONARY).items():
        test = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        parts.append(f"CASE WHEN {test} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL)"


@REG.add("g7_tag", f"SELECT doc_id, array_to_string({tag_sql('text')}, ',') AS tags FROM documents")
def g7(spark, d):
    out = s.tag(load(spark, d, "documents"), "text", DICTIONARY)
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"))


def _search(df, vec, k, metric="cosine", **kw):
    return v.knn(df, vec, k, metric, **kw).select(F.col("vec_id").alias("id"), "distance", "label")


@REG.add(
    "g8_merge_hits",
    f"""
    WITH a AS (SELECT vec_id AS id, 0 AS strategy, distance, label FROM ({HITS}) ORDER BY distance, vec_id LIMIT 15),
         b AS (SELECT vec_id AS id, 1 AS strategy, distance, label FROM ({HITS}) WHERE label = 3
               ORDER BY distance, vec_id LIMIT 15),
         c AS (SELECT vec_id AS id, 2 AS strategy, distance, label FROM ({HITS}) WHERE distance <= 0.9
               ORDER BY distance, vec_id LIMIT 30)
    SELECT id, strategy, distance, label FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY strategy, distance) AS rn
        FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)) WHERE rn = 1
    """,
)
def g8(spark, d):
    df, vec = load(spark, d, "embeddings"), _first_vector(spark, d)
    return s.merge_hits(
        _search(df, vec, 15), _search(df, vec, 15, filters=F.col("label") == 3), _search(df, vec, 30, max_d=0.9)
    )


RANKED_QUERY = "count the number of group3 items with odd id and small distance"


@REG.add(
    "g9_rank_hits",
    f"""
    SELECT id, name, distance,
           round(least(1.0, greatest(0.0, 1.0 - distance)
               + CASE WHEN contains('{RANKED_QUERY}', lower(name)) THEN 0.3 ELSE 0 END
               + 0.2 * (CASE WHEN contains('{RANKED_QUERY}', parity) THEN 1 ELSE 0 END
                        + CASE WHEN contains('{RANKED_QUERY}', size) THEN 1 ELSE 0 END) + 0.1), 6) AS relevance
    FROM (SELECT vec_id AS id, concat('group', label) AS name, distance,
                 CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
                 CASE WHEN label < 5 THEN 'small' ELSE 'large' END AS size
          FROM ({HITS}) ORDER BY distance, vec_id LIMIT 100)
    WHERE distance <= 0.8 ORDER BY relevance DESC, id LIMIT 20
    """,
)
def g9(spark, d):
    hits = _search(load(spark, d, "embeddings"), _first_vector(spark, d), 100).select(
        "id",
        F.concat(F.lit("group"), F.col("label").cast("string")).alias("name"),
        "distance",
        F.array(
            F.when(F.col("id") % 2 == 0, "even").otherwise("odd"),
            F.when(F.col("label") < 5, "small").otherwise("large"),
        ).alias("tags"),
        F.lit("float").alias("data_type"),
    )
    return s.rank_hits(hits, RANKED_QUERY, 20).select("id", "name", "distance", "relevance")


@REG.add(
    "g10_rollup_hits",
    f"""
    SELECT label, round(max(greatest(0.0, 1.0 - distance) * CASE WHEN vec_id % 5 = 0 THEN 1.0 ELSE 0.7 END), 6) AS score
    FROM (SELECT * FROM ({HITS}) ORDER BY distance, vec_id LIMIT 100) GROUP BY 1 ORDER BY score DESC, label LIMIT 5
    """,
)
def g10(spark, d):
    hits = _search(load(spark, d, "embeddings"), _first_vector(spark, d), 100).select(
        "label",
        F.when(F.col("id") % 5 == 0, "table").otherwise("column").alias("kind"),
        F.greatest(F.lit(0.0), 1.0 - F.col("distance")).alias("relevance"),
    )
    return s.rollup_hits(hits, "label", "kind", "relevance", 5)


LEXICAL_QUERY = "small ring economy brand#2"


def _items(spark, d):
    return load(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.array("p_brand", "p_type").alias("columns"),
        F.array(F.lower("p_type"), F.when(F.col("p_size") < 10, "small").otherwise("big")).alias("tags"),
    )


def _lexical_sql() -> str:
    parts = []
    for w in LEXICAL_QUERY.split():
        parts += [
            f"CASE WHEN contains(lower(p_name), '{w}') THEN 0.5 ELSE 0 END",
            f"CASE WHEN contains(lower(p_type), '{w}') THEN 0.5 ELSE 0 END",
            f"CASE WHEN contains(lower(p_brand), '{w}') THEN 0.2 ELSE 0 END",
        ]
    tag = lambda t: "CASE WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in LEXICAL_QUERY.split()) + " THEN 0.1 ELSE 0 END"
    parts += [tag("lower(p_type)"), tag("CASE WHEN p_size < 10 THEN 'small' ELSE 'big' END")]
    return "round(CAST(least(" + " + ".join(parts) + ", 1.0) AS DOUBLE), 6)"


@REG.add(
    "g11_lexical_score",
    f"""
    SELECT p_partkey, p_name AS name, {_lexical_sql()} AS score FROM part
    WHERE {_lexical_sql()} > 0 ORDER BY score DESC, p_partkey LIMIT 50
    """,
)
def g11(spark, d):
    return s.lexical_score(_items(spark, d), LEXICAL_QUERY, "p_partkey", 50)


CONCEPTS = {"entities": ["ring", "widget"], "attributes": ["brand#2", "promo"]}


def _concept_sql(entities, attributes) -> str:
    parts = ["0.0"]
    for e in entities:
        parts.append(
            f"CASE WHEN contains(lower(p_name), '{e}') THEN 0.4 WHEN contains(lower(p_brand), '{e}') "
            f"OR contains(lower(p_type), '{e}') THEN 0.2 ELSE 0 END"
        )
        parts.append(f"CASE WHEN contains(lower(p_type), '{e}') THEN 0.2 ELSE 0 END")
    for a in attributes:
        parts.append(
            f"CASE WHEN contains(lower(p_brand), '{a}') THEN 0.1 ELSE 0 END"
            f" + CASE WHEN contains(lower(p_type), '{a}') THEN 0.1 ELSE 0 END"
        )
    return "round(CAST(least(" + " + ".join(parts) + ", 1.0) AS DOUBLE), 6)"


def _select_sql(concepts) -> str:
    return f"""
    WITH s AS (SELECT p_partkey, p_name AS name, {_concept_sql(concepts.get('entities', []), concepts.get('attributes', []))}
                   AS score FROM part),
         k AS (SELECT * FROM s WHERE score > 0),
         c AS (SELECT * FROM k WHERE score > 0.3 UNION ALL
               (SELECT * FROM k WHERE (SELECT max(score) FROM k) <= 0.3 ORDER BY score DESC, p_partkey LIMIT 3))
    SELECT *, round(least(0.8, (SELECT CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*) FROM c)), 6)
        AS confidence FROM c
    """


@REG.add("g12_concept_select", _select_sql(CONCEPTS))
def g12(spark, d):
    return s.concept_select(_items(spark, d), CONCEPTS, "p_partkey")


@REG.add("g12_concept_fallback", _select_sql({"attributes": CONCEPTS["attributes"]}))
def g12_rest(spark, d):
    return s.concept_select(_items(spark, d), {"attributes": CONCEPTS["attributes"]}, "p_partkey")


GIVEN = """
    SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE substr(s_name, 4) END AS given
    FROM supplier
"""


@REG.add(
    "g13_match_names",
    f"""
    WITH g AS ({GIVEN}),
    c AS (SELECT given, s_name AS known, s_suppkey,
                 CASE WHEN given = s_name THEN 'exact' WHEN lower(given) = lower(s_name) THEN 'case' ELSE 'partial' END
                     AS match
          FROM g JOIN supplier ON given = s_name OR lower(given) = lower(s_name)
              OR (length(given) > 3 AND contains(lower(s_name), lower(given)))
              OR (length(s_name) > 3 AND contains(lower(given), lower(s_name))))
    SELECT given, known, match FROM (
        SELECT *, row_number() OVER (PARTITION BY given ORDER BY CASE match WHEN 'exact' THEN 0 ELSE 1 END, s_suppkey)
            AS rn FROM c) WHERE rn = 1
    """,
)
def g13(spark, d):
    known = load(spark, d, "supplier").select("s_suppkey", "s_name")
    third = F.col("s_suppkey") % 3
    given = known.select(
        F.when(third == 0, F.col("s_name"))
        .when(third == 1, F.upper("s_name"))
        .otherwise(F.expr("substr(s_name, 4)"))
        .alias("given")
    )
    return s.match_names(given, "given", known, "s_name", "s_suppkey")


TAGGED = f"SELECT doc_id, source, lang, {tag_sql('text')} AS tags FROM documents"


def _tagged(spark, d):
    return s.tag(load(spark, d, "documents"), "text", DICTIONARY).select("doc_id", "source", "lang", "tags")


@REG.add(
    "g14_corpus_stats",
    f"""
    SELECT 'documents' AS figure, count(*) AS value FROM documents
    UNION ALL SELECT 'groups', count(DISTINCT source) FROM documents
    UNION ALL SELECT concat('kind:', lang), count(*) FROM documents GROUP BY lang
    UNION ALL SELECT 'tags', count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM ({TAGGED}))
    """,
)
def g14(spark, d):
    return s.corpus_stats(_tagged(spark, d), "source", "lang", "tags")


def _column_rows(table, families, keys):
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type,
            (SELECT count(*) FROM {table}) AS total_count, (SELECT count(DISTINCT {c}) FROM {table}) AS distinct_count,
            (SELECT count(*) - count({c}) FROM {table}) AS null_count,
            {f"(SELECT CAST(min({c}) AS VARCHAR) FROM {table})" if kind in ("integer", "numeric") else
             f"(SELECT strftime(min({c}), '%Y-%m-%d %H:%M:%S.%f') FROM {table})" if kind == "temporal" else
             "CAST(NULL AS VARCHAR)"} AS min_value,
            {f"(SELECT CAST(max({c}) AS VARCHAR) FROM {table})" if kind in ("integer", "numeric") else
             f"(SELECT strftime(max({c}), '%Y-%m-%d %H:%M:%S.%f') FROM {table})" if kind == "temporal" else
             "CAST(NULL AS VARCHAR)"} AS max_value,
            {f"(SELECT {mean(c)} FROM {table})" if kind in ("integer", "numeric") else "CAST(NULL AS DOUBLE)"} AS avg_value,
            (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table}
             WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples"""
        for c, kind in families.items()
    )


PROFILE_ROWS = (
    _column_rows("orders", dict(zip(ORDERS, ["integer", "integer", "text", "numeric", "temporal", "text"])), None)
    + " UNION ALL "
    + _column_rows("customer", dict(zip(CUSTOMER, ["integer", "text", "integer", "numeric", "text"])), None)
)
DOCUMENTS = f"""
    SELECT table_name, CAST(NULL AS VARCHAR) AS column_name, 'table' AS kind,
           concat_ws(' | ', concat('Table: ', table_name), concat('Columns: ', count(*)),
               concat('Key columns: ', array_to_string(list_slice(list(column_name ORDER BY column_name) FILTER (
                   WHERE contains(column_name, 'id') OR contains(column_name, 'key') OR contains(column_name, 'name')
                      OR contains(column_name, 'email')), 1, 5), ', ')),
               concat('Contains ', max(total_count), ' records')) AS content
    FROM ({PROFILE_ROWS}) GROUP BY table_name
    UNION ALL
    SELECT table_name, column_name, 'column', concat_ws(' | ', concat('Column: ', table_name, '.', column_name),
           concat('Type: ', data_type), concat('Distinct: ', distinct_count), concat('Examples: ', samples))
    FROM ({PROFILE_ROWS})
"""


def _profiles(spark, d):
    out = [
        pr.column_profile(load(spark, d, t)).withColumn("table_name", F.lit(t)) for t in ("orders", "customer")
    ]
    # One row per column, read more than once below: compute it once.
    return materialize(out[0].unionByName(out[1]))


@REG.add("g15_build_documents", DOCUMENTS)
def g15(spark, d):
    return s.build_documents(_profiles(spark, d))


@REG.add(
    "g16_hits_by_parent",
    f"""
    WITH h AS (SELECT * FROM ({HITS}) ORDER BY distance, vec_id LIMIT 100),
         k AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 10 FROM embeddings))
    SELECT label, count(*) AS hits, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY distance, vec_id) AS items
    FROM h WHERE label IN (SELECT label FROM k) GROUP BY label
    """,
)
def g16(spark, d):
    df = load(spark, d, "embeddings")
    hits = v.knn(df, _first_vector(spark, d), 100)
    share = df.agg((F.count("*") / 10).alias("n")).scalar()
    keep = df.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= share)
    out = s.hits_by_parent(hits, keep, "label", "vec_id", "distance")
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


KEEP = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in [*KEYS, "lineitem", "labels", "events"])


@REG.add(
    "g17_link_summary",
    f"""
    WITH k AS (SELECT table_name FROM ({KEEP}) WHERE n >= 100),
         e AS (SELECT source_table, target_table FROM ({DISCOVERED}) WHERE verified
               AND source_table IN (SELECT table_name FROM k) AND target_table IN (SELECT table_name FROM k)),
         p AS (SELECT source_table, string_agg(DISTINCT target_table, ',' ORDER BY target_table) AS targets,
                      count(*) AS links FROM e GROUP BY 1)
    SELECT *, (SELECT count(*) FROM p) AS connected, (SELECT CAST(sum(links) AS BIGINT) FROM p) AS total_links FROM p
    """,
)
def g17(spark, d):
    named = key_tables(spark, d)
    edges = materialize(relate.discover_relationships(named, KEYS).filter("verified"))
    keep = materialize(table_inventory(named).filter("row_count >= 100"))
    out = s.link_summary(edges, keep, "source_table", "target_table", "table_name")
    return out.withColumn("targets", F.array_join("targets", ","))


NAMES = "SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE name <> ''"


@REG.add(
    "g18_mentions",
    f"""
    SELECT doc_id, name, place FROM (
        SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS place
        FROM documents JOIN ({NAMES}) ON contains(lower(text), lower(name))) WHERE place <= 3
    """,
)
def g18(spark, d):
    names = load(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).filter("name <> ''")
    return s.mentions(load(spark, d, "documents"), "doc_id", "text", names, "name")


@REG.add(
    "g19_tag_index",
    f"""
    WITH t AS (SELECT DISTINCT unnest(tags) AS tag, doc_id FROM ({TAGGED})),
         r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY doc_id) AS rn,
                      count(*) OVER (PARTITION BY tag) AS members FROM t)
    SELECT tag, max(members) AS members, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS listed
    FROM r WHERE rn <= 10 AND members > 1 GROUP BY tag
    """,
)
def g19(spark, d):
    out = s.tag_index(_tagged(spark, d), "doc_id")
    return out.withColumn("listed", F.array_join(F.col("listed").cast("array<string>"), ","))


TURNS = f"SELECT concat(conv_id, ':', turn) AS id, conv_id, turn, {tag_sql('text')} AS tags FROM conversations"


@REG.add(
    "g20_shared_tags",
    f"""
    WITH t AS ({TURNS}),
    p AS (SELECT a.id AS source, b.id AS target, list_sort(list_intersect(a.tags, b.tags)) AS shared
          FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT source, target, array_to_string(shared, ',') AS shared FROM p WHERE len(shared) > 0
    """,
)
def g20(spark, d):
    turns = s.tag(load(spark, d, "conversations"), "text", DICTIONARY).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "tags",
    )
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("target"))
    edges = turns.select("conv_id", "turn", F.col("id").alias("source")).join(later, ["conv_id", "turn"])
    out = s.shared_tags(edges.select("source", "target"), turns, "source", "target", "id")
    return out.select("source", "target", F.array_join("shared", ",").alias("shared"))


@REG.add(
    "g21_enriched_profile",
    f"""
    WITH p AS ({PROFILE_ROWS}), d AS ({DOCUMENTS})
    SELECT p.table_name, p.column_name, concat_ws('; ', concat('total=', total_count),
           concat('distinct=', distinct_count), concat('nulls=', null_count), 'min=' || min_value,
           'max=' || max_value, 'avg=' || CAST(avg_value AS VARCHAR)) AS facts, content
    FROM p LEFT JOIN d ON p.table_name = d.table_name AND p.column_name = d.column_name AND d.kind = 'column'
    """,
)
def g21(spark, d):
    profiles = _profiles(spark, d)
    return s.enriched_profile(profiles, s.build_documents(profiles))
