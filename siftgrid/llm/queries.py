"""The queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrid.lineage import cut
from siftgrid.llm import distinctive, encode, frequency, overlap, packing, residue, similar, together
from siftgrid.llm.terms import record_sets
from siftgrid.sources.tables import table

LARGE_LEAST, LARGE_SHARE = 20, 500


def p1_counters(spark: SparkSession, d: str) -> DataFrame:
    """(field, term, occurrences, records, n, marks) of every term or key of the three fields."""
    tokens = (
        frequency.text_tokens(table(spark, d, "article"), "article.features", "article_id", "features")
        .unionByName(frequency.text_tokens(table(spark, d, "animal"), "animal.features", "row_id", "features"))
        .unionByName(frequency.key_tokens(table(spark, d, "posting"), "posting"))
    )
    shards = frequency.shards_of(table(spark, d, "posting")) + frequency.shards_of(table(spark, d, "article"))
    return frequency.marked_terms(frequency.term_counters(tokens, shards), frequency.record_counts(tokens))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_counters(spark, d).select("field", "term", F.explode("marks").alias("mark"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return p1_counters(spark, d).select("field", "term", "occurrences", "records")


def _set_records(spark: SparkSession, d: str) -> DataFrame:
    """(uid, id, is_article, terms) of articles and of decisions without article, with at least four terms."""
    articles = record_sets(table(spark, d, "article"), "article_id", "features").withColumn("is_article", F.lit(True))
    decisions = record_sets(table(spark, d, "decision").filter("article_id IS NULL"), "decision_id", "features").withColumn("is_article", F.lit(False))
    both = articles.unionByName(decisions).filter(F.size("terms") >= 4)
    return both.withColumn("uid", F.col("id") * 2 + F.when(F.col("is_article"), 0).otherwise(1))


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The computed classes of equal sets, with whether an article is among them, and the members (uid, cls)."""
    classes, members = similar.set_classes(cut(_set_records(spark, d)), F.bool_or("is_article").alias("wanted"))
    classes = cut(classes)
    return classes, cut(members.join(classes.select("digest", "cls"), "digest").select("uid", "cls"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes one of which has an article, expanded from its articles to the members of the other, or of the same."""
    classes, members = _classes(spark, d)
    pairs = similar.similar_classes(classes)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.x", "p.y")
    links = both.unionByName(classes.filter("wanted").select(F.col("cls").alias("x"), F.col("cls").alias("y")))
    articles, others = members.filter("uid % 2 = 0").select(F.col("cls").alias("x"), F.col("uid").alias("u")), members.select(F.col("cls").alias("y"), F.col("uid").alias("v"))
    uids = links.join(articles, "x").join(others, "y").filter("v % 2 <> 0 OR u < v")
    return uids.select(F.shiftright("u", 1).alias("id_1"), F.shiftright("v", 1).alias("id_2"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: its class of equal sets and the number of other classes that are similar to it, decisions included."""
    classes, members = _classes(spark, d)
    links = similar.similar_classes(classes.drop("wanted")).select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "cls", "left").select((F.col("uid") % 2 == 0).alias("is_article"), F.shiftright("uid", 1).alias("id"), F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(source, term_1, term_2, n, f_a, f_b, f_ab, association) of the strong pairs of both sources."""
    entries = cut(together.basket_entries(table(spark, d, "article"), "article_id", "features"))
    n = entries.select("basket").distinct().count()
    reported = together.summed_reports(table(spark, d, "costats")).filter(together.strong(8, 1000, 4))
    both = together.cooccurrence(entries, n).withColumn("source", F.lit("article")).unionByName(reported.withColumn("source", F.lit("costats")))
    return both.select("source", F.col("item_1").alias("term_1"), F.col("item_2").alias("term_2"), "n", "f_a", "f_b", "f_ab", F.round("association", 6).alias("association"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("source", "term_1", "term_2")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose estimate leaves the result's conditions possible at six standard deviations, then counted exactly."""
    entries, large, n = overlap.large_sets(table(spark, d, "posting"), LARGE_LEAST, LARGE_SHARE)
    estimates = overlap.overlap_estimates(entries, large, overlap.sampling_rate(n, LARGE_LEAST, LARGE_SHARE), z=6.0)
    chance = F.lit(3.0) * F.col("f_1") * F.col("f_2") / F.lit(float(max(n, 1)))
    possible = cut(estimates.filter((F.col("high") * 2 >= F.least("f_1", "f_2")) & (F.col("high") >= chance * (1 - 1e-9))).select("item_1", "item_2", "key_1", "key_2", "f_1", "f_2"))
    exact = overlap.exact_overlaps(entries, possible.select("item_1", "item_2")).join(possible, ["item_1", "item_2"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    enough = (F.col("f_ab") * 2 >= F.least("f_1", "f_2")) & (big("f_ab") * F.lit(n).cast("decimal(19,0)") >= F.lit(3).cast("decimal(1,0)") * (big("f_1") * big("f_2")).cast("decimal(37,0)"))
    return exact.filter(enough).select("key_1", "key_2")


def p4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Estimated overlaps of all pairs of large keys that share a retained identifier, with 95 % intervals."""
    entries, large, n = overlap.large_sets(table(spark, d, "posting"), LARGE_LEAST, LARGE_SHARE)
    estimates = overlap.overlap_estimates(entries, large, overlap.sampling_rate(n, LARGE_LEAST, LARGE_SHARE))
    return estimates.select("key_1", "key_2", "f_1", "f_2", *(F.round(c, 3).alias(c) for c in ("estimate", "low", "high")))


def _weights(spark: SparkSession, d: str, hits_only: bool) -> DataFrame:
    records = cut(record_sets(table(spark, d, "decision"), "decision_id", "features", F.max("hit").alias("hit")))
    df = cut(distinctive.document_frequencies(records))
    total = df.agg(F.sum("df")).first()[0] or 1
    scored = records.filter("hit") if hits_only else records
    return distinctive.distinctive_terms(distinctive.with_frequencies(scored.select("id", "terms"), df, total), total)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, True).filter("top").select(F.col("id").alias("decision_id"), "term")


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    """(decision_id, term, df, weight) of every term of every decision."""
    return _weights(spark, d, False).select(F.col("id").alias("decision_id"), "term", "df", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_classes, p3_found, p3_pairs, p4_found, p4_overlaps, p5_found, p5_weights)}

_TERMS = r"list_filter(regexp_split_to_array(lower(nfc_normalize(features)), '[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},;|]+'), lambda x: x <> '')"
_ART = f"art AS (SELECT DISTINCT CAST(article_id AS BIGINT) AS id, unnest({_TERMS}) AS term FROM article WHERE article_id IS NOT NULL)"
_KEY = "col || '=' || coalesce(value_str, CAST(value_num AS VARCHAR))"
_POST = f"post AS (SELECT DISTINCT {_KEY} AS term, row_id AS id FROM posting WHERE row_id IS NOT NULL AND {_KEY} IS NOT NULL)"
_TOK = f"""tok AS (
  SELECT 'article.features' AS field, CAST(article_id AS BIGINT) AS id, unnest({_TERMS}) AS term FROM article WHERE article_id IS NOT NULL
  UNION ALL SELECT 'animal.features', row_id, unnest({_TERMS}) FROM animal WHERE row_id IS NOT NULL
  UNION ALL SELECT 'posting', row_id, {_KEY} FROM posting WHERE row_id IS NOT NULL AND {_KEY} IS NOT NULL)"""
_SIM = f"""WITH {_ART}, dec AS (SELECT DISTINCT decision_id AS id, unnest({_TERMS}) AS term FROM decision WHERE article_id IS NULL AND decision_id IS NOT NULL),
  r AS (SELECT id, true AS a, term FROM art UNION ALL SELECT id, false, term FROM dec),
  z AS (SELECT id, a, term, count(*) OVER (PARTITION BY id, a) AS s FROM r),
  p AS (SELECT x.id AS i, y.id AS j, y.a AS ya, x.s AS s, y.s AS t, count(*) AS c FROM z x JOIN z y ON x.term = y.term AND x.a AND (NOT y.a OR x.id < y.id)
    WHERE x.s >= 4 AND y.s >= 4 GROUP BY ALL)"""
_OVER = f"""WITH {_POST}, n AS (SELECT count(DISTINCT id) AS n FROM post), f AS (SELECT term, count(*) AS f FROM post GROUP BY 1),
  l AS (SELECT term, f FROM f, n WHERE f >= 20 AND 500 * f >= n), e AS (SELECT post.term, id, f FROM post JOIN l USING (term)),
  o AS (SELECT a.term AS key_1, b.term AS key_2, a.f AS f_1, b.f AS f_2, count(*) AS f_ab FROM e a JOIN e b ON a.id = b.id AND a.term < b.term GROUP BY ALL)"""
_STRONG = "f_ab >= 8 AND 1000 * f_ab >= n AND CAST(f_ab AS HUGEINT) * n >= 4 * CAST(f_a AS HUGEINT) * f_b"
_TOG = f"""WITH {_ART}, n AS (SELECT count(DISTINCT id) AS n FROM art), f AS (SELECT term, count(*) AS f FROM art GROUP BY 1),
  e AS (SELECT id, term, f FROM art JOIN f USING (term) WHERE f >= 8),
  p AS (SELECT a.term AS term_1, b.term AS term_2, a.f AS f_a, b.f AS f_b, count(*) AS f_ab FROM e a JOIN e b ON a.id = b.id AND a.term < b.term GROUP BY ALL),
  k AS (SELECT *, col_a || '=' || value_a AS ka, col_b || '=' || value_b AS kb FROM costats WHERE n IS NOT NULL AND f_ab <= f_a AND f_ab <= f_b),
  s AS (SELECT DISTINCT segment, least(ka, kb) AS term_1, greatest(ka, kb) AS term_2, n, CASE WHEN ka > kb THEN f_b ELSE f_a END AS f_a, CASE WHEN ka > kb THEN f_a ELSE f_b END AS f_b, f_ab FROM k),
  c AS (SELECT term_1, term_2, sum(n)::BIGINT AS n, sum(f_a)::BIGINT AS f_a, sum(f_b)::BIGINT AS f_b, sum(f_ab)::BIGINT AS f_ab FROM s GROUP BY ALL),
  u AS (SELECT 'article' AS source, term_1, term_2, n, f_a, f_b, f_ab FROM p, n UNION ALL SELECT 'costats', term_1, term_2, n, f_a, f_b, f_ab FROM c)"""
_DEC = f"dec AS (SELECT DISTINCT decision_id AS id, unnest({_TERMS}) AS term FROM decision WHERE decision_id IS NOT NULL)"

SQL = {
    "p1_found": f"""WITH {_TOK}, f AS (SELECT field, term, count(DISTINCT id) AS f FROM tok GROUP BY ALL), n AS (SELECT field, count(DISTINCT id) AS n FROM tok GROUP BY 1)
SELECT field, term, 'rare' AS mark FROM f WHERE f <= 2 UNION ALL SELECT field, term, 'common' FROM f JOIN n USING (field) WHERE 5 * f > n""",
    "p1_terms": f"WITH {_TOK} SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM tok GROUP BY ALL",
    "p2_found": f"{_SIM} SELECT i AS id_1, j AS id_2 FROM p WHERE 4 * c >= 3 * (s + t - c)",
    "p2_classes": f"""WITH {_ART}, dec AS (SELECT DISTINCT decision_id AS id, unnest({_TERMS}) AS term FROM decision WHERE article_id IS NULL AND decision_id IS NOT NULL),
  r AS (SELECT id, true AS a, list(term ORDER BY term) AS t FROM art GROUP BY id UNION ALL SELECT id, false, list(term ORDER BY term) FROM dec GROUP BY id), q AS (SELECT *, 2 * id + CASE WHEN a THEN 0 ELSE 1 END AS uid FROM r WHERE len(t) >= 4),
  c AS (SELECT t, min(uid) AS cls, any_value(len(t)) AS s FROM q GROUP BY t), e AS (SELECT cls, s, unnest(t) AS term FROM c),
  p AS (SELECT x.cls AS i, y.cls AS j, x.s AS s, y.s AS t, count(*) AS n FROM e x JOIN e y ON x.term = y.term AND x.cls <> y.cls GROUP BY ALL), l AS (SELECT i AS cls, count(*) AS links FROM p WHERE 4 * n >= 3 * (s + t - n) GROUP BY 1)
SELECT a AS is_article, id, cls AS class_id, coalesce(links, 0) AS links FROM q JOIN c USING (t) LEFT JOIN l USING (cls)""",
    "p3_found": f"{_TOG} SELECT source, term_1, term_2 FROM u WHERE {_STRONG}",
    "p3_pairs": f"{_TOG} SELECT source, term_1, term_2, n, f_a, f_b, f_ab, round(f_ab::DOUBLE * n / (f_a::DOUBLE * f_b), 6) AS association FROM u WHERE {_STRONG}",
    "p4_found": f"{_OVER} SELECT key_1, key_2 FROM o, n WHERE 2 * f_ab >= least(f_1, f_2) AND f_ab * n >= 3 * f_1 * f_2",
    "p5_found": f"""WITH {_DEC}, f AS (SELECT term, count(*) AS f FROM dec GROUP BY 1), h AS (SELECT DISTINCT decision_id AS id FROM decision WHERE hit),
  r AS (SELECT id, term, f, min(f) OVER (PARTITION BY id) AS m FROM dec JOIN f USING (term) JOIN h USING (id))
SELECT id AS decision_id, term FROM r WHERE f = m""",
}


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tokens, same): whether decoding the ids gives the text again, null and empty both counting as empty."""
    documents = table(spark, d, "documents")
    ids = encode.encode_ids(documents, "doc_id", "text")
    texts = encode.decode_ids(ids, "doc_id").withColumnRenamed("text", "again")
    return documents.select("doc_id", "text").join(texts, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("again")).alias("same"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "capacities").select("container_kind", F.col("capacity_tokens").alias("capacity"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens): the documents in containers of each kind."""
    sizes = cut(encode.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.fill_containers(sizes, _kinds(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), _kinds(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """(container_kind, overfull, split, documents): containers above their capacity, documents in several pieces or with tokens
    missing though they are not longer than the capacity, and documents placed. The first two are 0."""
    sizes = cut(encode.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    filled, kinds = cut(packing.fill_containers(sizes, _kinds(spark, d))), _kinds(spark, d).distinct()
    loads = filled.filter("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("load")).join(kinds, "container_kind").groupBy("container_kind").agg(F.count(F.when(F.col("load") > F.col("capacity"), 1)).alias("overfull"))
    pieces = filled.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("placed")).join(sizes, "doc_id").join(kinds, "container_kind")
    wrong = (F.col("placed") != F.col("tokens")) | ((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")))
    return pieces.groupBy("container_kind").agg(F.count(F.when(wrong, 1)).alias("split"), F.count(F.lit(1)).alias("documents")).join(loads, "container_kind").select("container_kind", "overfull", "split", "documents")


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, reason) of documents with template residue, filler, error or script text."""
    return residue.residue_documents(cut(residue.evidence(table(spark, d, "documents").select("doc_id", "ruling_id", "text")), "kind"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_reasons(spark, d).select("doc_id").distinct()


QUERIES |= {f.__name__: f for f in (p6_ids, p6_round_trip, p7_containers, p7_report, p7_checks, p8_found, p8_reasons)}

SQL |= {
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_checks": "SELECT container_kind, 0::BIGINT AS overfull, 0::BIGINT AS split, (SELECT count(*) FROM documents)::BIGINT AS documents FROM (SELECT DISTINCT container_kind FROM capacities WHERE capacity_tokens > 0)",
}
