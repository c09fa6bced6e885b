"""Feature families, vocabularies, topics, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.functions.arrays import exploded
from citesift.operators import features as feat
from citesift.operators import feature_sets
from citesift.operators import topics as top
from citesift.operators.articles import CUTOFF_DATE, temporal_split
from citesift.registry import views
from citesift.session import durable

# Each iteration draws as many documents as there are, see Topics.fit.
TOPICS, ITERATIONS = 50, 10
# The words the query texts leave after the token filter, in sorted order, used to
# name the columns of the wide form.
_WORDS = ["de", "der", "en", "es", "la", "le", "therou", "tion", "und"]
# Names of the columns of the families that need no fit but for their scale.
_PLAIN = [p.lower().replace(" ", "_") for p in feat.PUBLICATION_TYPES] + [
    f"{w}_in_{place}" for place in ("abstract", "title") for w in _WORDS
]


def _wide(df: DataFrame, column: str, names) -> DataFrame:
    return df.select("article_id", *[F.col(column)[i].alias(n) for i, n in enumerate(names)])


def _term_matches(spark, sf_dir) -> DataFrame:
    """Vocabulary terms with the records that hold them."""
    vocab = feat.search_term_vocab(spark, views.QUERIES)
    found = views.records(spark, sf_dir).select(F.explode(F.array_distinct("tokens")).alias("term"))
    # As many rows as the queries have words.
    counts = found.join(F.broadcast(vocab), "term").groupBy("term").agg(F.count("*").alias("n"))
    return vocab.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n_records"))


def search_term_vocab(spark, sf_dir) -> DataFrame:
    return _term_matches(spark, sf_dir)


def search_term_features(spark, sf_dir) -> DataFrame:
    family = feat.SearchTerms.fit(spark, views.QUERIES)
    return _wide(family.transform(views.records(spark, sf_dir)), family.column, family.names)


def feature_names(spark, sf_dir) -> DataFrame:
    return _term_matches(spark, sf_dir).select(feat.feature_name(F.col("term")).alias("name"), "n_records")


def publication_type_features(spark, sf_dir) -> DataFrame:
    family = feat.PublicationTypes()
    return _wide(family.transform(views.articles(spark, sf_dir, False)), family.column, family.names)


def bigram_counts(spark, sf_dir) -> DataFrame:
    return feat.bigram_counts(views.records(spark, sf_dir))


def tfidf_vocab(spark, sf_dir) -> DataFrame:
    records = views.records(spark, sf_dir)
    return feat.tfidf_vocab(records, records.count())


def tfidf_transform(spark, sf_dir) -> DataFrame:
    """Vocabulary of the documents before the cut-off date, weights of all documents."""
    records = views.records(spark, sf_dir)
    old, _ = temporal_split(records)
    family = feat.BigramTfidf.fit(old)
    weights = exploded(family.transform(records), ["article_id"], family.column, "weight", "_i")
    return weights.filter("weight > 0").select(
        "article_id",
        F.element_at(F.lit(family.names), F.col("_i") + 1).alias("name"),
        F.round("weight", 6).alias("weight"),
    )


def lda_dictionary(spark, sf_dir) -> DataFrame:
    records = views.records(spark, sf_dir)
    return feat.lda_dictionary(records, records.count())


def bag_of_words(spark, sf_dir) -> DataFrame:
    records = views.records(spark, sf_dir)
    return feat.bag_of_words(records, feat.lda_dictionary(records, records.count()))


def _topics(spark, sf_dir) -> tuple[top.Topics, DataFrame]:
    records = durable(views.records(spark, sf_dir), "records")
    return top.Topics.fit(records, TOPICS, max_iter=ITERATIONS), records


def _topic_weights(spark, sf_dir) -> DataFrame:
    model, records = _topics(spark, sf_dir)
    return model.transform(records).select("article_id", F.col(model.column).alias("weights"))


def lda_fit(spark, sf_dir) -> DataFrame:
    """What every fit has: each topic weighs on all documents, and a document's weights are one together.

    The weights themselves, which depend on the fit, are ``lda_transform``.
    """
    weights = _topic_weights(spark, sf_dir)
    by_topic = exploded(weights, ["weights"], "weights", "w", "topic")
    return by_topic.groupBy("topic").agg(
        F.count_if((F.col("w") >= 0) & (F.col("w") <= 1)).alias("documents"),
        F.count_if(F.abs(F.aggregate("weights", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6).alias("whole"),
    )


def lda_transform(spark, sf_dir) -> DataFrame:
    weights = _topic_weights(spark, sf_dir)
    return weights.select("article_id", *[F.col("weights")[i].alias(f"lda_{i}") for i in range(TOPICS)])


def lda_documents(spark, sf_dir) -> DataFrame:
    """For every document the number of its weights and their sum."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    return _topic_weights(spark, sf_dir).select(
        "article_id", F.size("weights").cast("long").alias("n_weights"), F.round(total, 6).alias("total")
    )


def topic_terms(spark, sf_dir) -> DataFrame:
    model, _ = _topics(spark, sf_dir)
    return model.terms(spark)


def topic_term_order(spark, sf_dir) -> DataFrame:
    """For every topic and rank: is the term one of the dictionary, named once, and no heavier than the one before?"""
    model, records = _topics(spark, sf_dir)
    dictionary = feat.lda_dictionary(records, records.count()).select("term", F.lit(True).alias("known"))
    # Ten terms a topic.
    named = model.terms(spark).join(dictionary, "term", "left")
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    return named.select(
        "topic",
        "rank",
        F.coalesce("known", F.lit(False)).alias("in_dictionary"),
        (F.count("*").over(Window.partitionBy("topic", "term")) == 1).alias("named_once"),
        F.coalesce(F.col("weight") <= before, F.lit(True)).alias("falling"),
    )


def topic_coherence(spark, sf_dir) -> DataFrame:
    """Coherence of given topics: the forty most widespread dictionary terms, in tens."""
    records = views.records(spark, sf_dir)
    common = feat.lda_dictionary(records, records.count(), keep_n=40)
    rank = F.row_number().over(Window.orderBy(F.col("df").desc(), "term"))
    given = durable(common.select(F.floor((rank - 1) / 10).cast("int").alias("topic"), "term"), "topics")
    return top.topic_coherence(records, given).withColumn("coherence", F.round("coherence", 6))


def model_coherence(spark, sf_dir) -> DataFrame:
    model, records = _topics(spark, sf_dir)
    return top.topic_coherence(records, durable(model.terms(spark, 20), "topics"))


def combine(spark, sf_dir) -> DataFrame:
    """Publication types, search terms and the topic-free length, made apart and joined."""
    documents = views.articles(spark, sf_dir, False)
    long_ones = documents.filter("n_chars >= 1000").select("article_id", F.lit(1.0).alias("long"))
    return feat.combine([publication_type_features(spark, sf_dir), search_term_features(spark, sf_dir), long_ones])


def standardize(spark, sf_dir) -> DataFrame:
    rows = views.articles(spark, sf_dir, False).select(
        "article_id",
        "publication_date",
        F.array(
            F.col("n_chars").cast("double"),
            F.col("publication_types").contains("Revie").cast("double"),
            (F.length("title") % 7).cast("double"),
            F.lit(3.5),
        ).alias("features"),
    )
    old, new = temporal_split(rows)
    train, test = feat.standardize(old, new)
    both = train.unionByName(test)
    return both.select(
        "article_id", *[F.round(F.col("features")[i], 6).alias(f"z{i}") for i in range(4)]
    )


def _full_set(spark, sf_dir) -> tuple[feature_sets.FeatureModel, DataFrame]:
    records = durable(views.records(spark, sf_dir), "records")
    old = F.col("publication_date") < F.lit(CUTOFF_DATE)
    return feature_sets.fitted_features(
        "full", records, old, views.QUERIES, ["article_id"], n_topics=TOPICS, lda_iterations=ITERATIONS
    )


def feature_set_full(spark, sf_dir) -> DataFrame:
    """The full scaled set, fitted on documents before the cut-off, for all documents."""
    model, rows = _full_set(spark, sf_dir)
    return _wide(rows, "features", model.names)


def feature_set_plain(spark, sf_dir) -> DataFrame:
    """Of the full scaled set, the columns that no topic model decides, and the number of all columns."""
    model, rows = _full_set(spark, sf_dir)
    plain = [(i, n) for i, n in enumerate(model.names) if n in _PLAIN]
    return rows.select(
        "article_id",
        F.size("features").cast("long").alias("n_columns"),
        *[F.round(F.col("features")[i], 6).alias(n) for i, n in plain],
    )


QUERIES = {
    "search_term_vocab": search_term_vocab,
    "search_term_features": search_term_features,
    "feature_names": feature_names,
    "publication_type_features": publication_type_features,
    "bigram_counts": bigram_counts,
    "tfidf_vocab": tfidf_vocab,
    "tfidf_transform": tfidf_transform,
    "lda_dictionary": lda_dictionary,
    "bag_of_words": bag_of_words,
    "lda_fit": lda_fit,
    "lda_transform": lda_transform,
    "lda_documents": lda_documents,
    "topic_terms": topic_terms,
    "topic_term_order": topic_term_order,
    "topic_coherence": topic_coherence,
    "model_coherence": model_coherence,
    "combine": combine,
    "standardize": standardize,
    "feature_set_full": feature_set_full,
    "feature_set_plain": feature_set_plain,
}

_QUERY_TEXT = " ".join(q.text() for q in views.QUERIES)

_VOCAB = f"""
words as (select unnest(list_distinct({views.sql_lemmas("q")})) as w from (select '{_QUERY_TEXT}' as q)),
vocab as (select w as term, w || '_in_abstract' as name from words
          union all select 'title_' || w, w || '_in_title' from words)"""

_TERM_COUNTS = f"""with {views.SQL_RECORDS}, {_VOCAB},
held as (select unnest(list_distinct(tokens)) as term from records),
counts as (select term, count(*) as n from held group by term)
select {{column}}, coalesce(n, 0) as n_records from vocab left join counts using (term)"""

_TERM_COLUMNS = ", ".join(
    f"cast(list_contains(tokens, '{prefix}{w}') as int)::double as {w}_in_{place}"
    for prefix, place in (("", "abstract"), ("title_", "title"))
    for w in _WORDS
)
_TYPE_COLUMNS = ", ".join(
    f"cast(contains(publication_types, '{p}') as int)::double as {p.lower().replace(' ', '_')}"
    for p in feat.PUBLICATION_TYPES
)

_BIGRAMS = """
paired as (
  select article_id, publication_date, g from (
    select article_id, publication_date,
      unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) as g
    from (select article_id, publication_date, list_filter(tokens, lambda t: length(t) >= 2) as w from records)
    where len(w) >= 2)),
counts as (select article_id, publication_date, g as bigram, count(*) as n from paired group by all)"""


def _tfidf_vocab_sql(counts: str, docs: str) -> str:
    return f"""
vocab as (
  select bigram as term, count(*) as df, cast(sum(n) as bigint) as tf from {counts} group by bigram
  having count(*) between 0.01 * (select count(*) from {docs}) and 0.5 * (select count(*) from {docs})
  order by tf desc, term limit 50)"""


_DICTIONARY = """
dictionary as (
  select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from records) group by term
  having count(*) >= 20 and count(*) <= floor(0.4 * (select count(*) from records)))"""

ORACLE = {
    "search_term_vocab": _TERM_COUNTS.replace("{column}", "term"),
    "feature_names": _TERM_COUNTS.replace("{column}", "name"),
    "search_term_features": f"with {views.SQL_RECORDS} select article_id, {_TERM_COLUMNS} from records",
    "publication_type_features": f"with {views.SQL_ARTICLES} select article_id, {_TYPE_COLUMNS} from articles",
    "bigram_counts": f"with {views.SQL_RECORDS}, {_BIGRAMS} select article_id, bigram, n from counts",
    "tfidf_vocab": f"""with {views.SQL_RECORDS}, {_BIGRAMS}, {_tfidf_vocab_sql('counts', 'records')}
select term, df, tf from vocab""",
    "tfidf_transform": f"""with {views.SQL_RECORDS}, {_BIGRAMS},
old as (select * from records where publication_date < date '2020-04-17'),
old_counts as (select * from counts where publication_date < date '2020-04-17'),
{_tfidf_vocab_sql('old_counts', 'old')},
weighted as (
  select article_id, term, (1 + ln(n)) * (ln((1 + (select count(*) from old)) / (1 + df)) + 1) as w
  from counts join vocab on bigram = term)
select article_id, 'tf-idf_' || replace(term, ' ', '_') as name,
  round(w / sqrt(sum(w * w) over (partition by article_id)), 6) as weight from weighted""",
    "lda_dictionary": f"with {views.SQL_RECORDS}, {_DICTIONARY} select term, df from dictionary",
    "bag_of_words": f"""with {views.SQL_RECORDS}, {_DICTIONARY}
select article_id, term, count(*) as n
from (select article_id, unnest(tokens) as term from records) join dictionary using (term) group by all""",
    # Lists every window of every occurrence, unlike the interval counting in Spark.
    "topic_coherence": f"""with {views.SQL_RECORDS}, {_DICTIONARY},
given as (select cast((row_number() over (order by df desc, term) - 1) // 10 as int) as topic, term
          from dictionary order by df desc, term limit 40),
occurrences as (
  select article_id, len(tokens) as len, unnest(range(len(tokens))) as p, unnest(tokens) as term from records),
hits as (select * from occurrences join (select distinct term from given) using (term)),
total as (select cast(sum(greatest(1, len - 109)) as double) as n from (select distinct article_id, len from hits)),
windows as (
  select distinct article_id, term,
    unnest(range(greatest(0, p - 109), least(p, greatest(0, len - 110)) + 1)) as s from hits),
single as (select term, count(*) as c from windows group by term),
joint as (select a.term as ta, b.term as tb, count(*) as c
          from windows a join windows b using (article_id, s) group by 1, 2),
grid as (
  select x.topic, x.term as ta, y.term as tb, coalesce(j.c, 0) / n as pj, sa.c / n as pa, sb.c / n as pb
  from given x join given y on x.topic = y.topic cross join total
  join single sa on sa.term = x.term join single sb on sb.term = y.term
  left join joint j on j.ta = x.term and j.tb = y.term),
npmi as (select topic, ta, tb, ln((pj + 1e-12) / (pa * pb)) / -ln(pj + 1e-12) as v from grid),
whole as (select topic, tb, sum(v) as t from npmi group by 1, 2),
cosine as (select topic, ta, sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t))) as c
           from npmi join whole using (topic, tb) group by 1, 2)
select topic, round(avg(c), 6) as coherence from cosine group by topic""",
    "combine": f"""with {views.SQL_RECORDS}
select r.article_id, {_TYPE_COLUMNS.replace('publication_types', 'r.publication_types')}, {_TERM_COLUMNS},
  case when a.n_chars >= 1000 then 1.0::double else 0.0::double end as long
from records r join articles a using (article_id)""",
    "standardize": f"""with {views.SQL_ARTICLES},
x as (select article_id, publication_date, cast(n_chars as double) as f0,
             cast(contains(publication_types, 'Revie') as int)::double as f1,
             cast(length(title) % 7 as double) as f2, 3.5::double as f3 from articles),
s as (select avg(f0) m0, stddev_pop(f0) s0, avg(f1) m1, stddev_pop(f1) s1, avg(f2) m2, stddev_pop(f2) s2, avg(f3) m3
      from x where publication_date < date '2020-04-17')
select article_id, round((f0 - m0) / s0, 6) as z0, round((f1 - m1) / s1, 6) as z1,
  round((f2 - m2) / s2, 6) as z2, round(f3 - m3, 6) as z3 from x, s""",
    "lda_fit": f"""with n as (select count(*) as n from documents)
select cast(unnest(range({TOPICS})) as int) as topic, n as documents, n as whole from n""",
    "lda_documents": f"""select doc_id as article_id, cast({TOPICS} as bigint) as n_weights, cast(1 as double) as total
from documents""",
    "topic_term_order": f"""with {views.SQL_RECORDS}, {_DICTIONARY},
n as (select least(count(*), 10) as n from dictionary)
select cast(topic as int) as topic, cast(rank as int) as rank, true as in_dictionary, true as named_once, true as falling
from n, (select unnest(range({TOPICS})) as topic), (select unnest(range(1, 11)) as rank) where rank <= n""",
    "feature_set_plain": f"""with {views.SQL_RECORDS}, {_BIGRAMS},
old as (select * from records where publication_date < date '2020-04-17'),
old_counts as (select * from counts where publication_date < date '2020-04-17'),
{_tfidf_vocab_sql('old_counts', 'old')},
x as (select article_id, publication_date, {_TYPE_COLUMNS}, {_TERM_COLUMNS} from records),
s as (select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _PLAIN)}
      from x where publication_date < date '2020-04-17')
select article_id, (select {len(_PLAIN) + TOPICS} + count(*) from vocab) as n_columns,
  {", ".join(f"round(({c} - m_{c}) / case when s_{c} > 1e-12 then s_{c} else 1 end, 6) as {c}" for c in _PLAIN)}
from x, s""",
}
