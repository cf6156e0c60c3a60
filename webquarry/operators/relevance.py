"""Terms, TF-IDF over the corpus, cosine against a task, best segments, dense vectors.

Documents are exchanged once, as raw text, on their key; counting terms and norms per
document then stays inside the partition.  The only other exchange is the one on the
term for document frequencies and their way back, where hot terms are salted.  With stems, where a part of the texts
holds many documents, rows stay with their texts: each part sends its distinct terms with their counts and gets their idf back.
Inverse document frequencies come from the corpus, not from the pair of page and task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.functions import text as T
from webquarry.operators import entities as E
from webquarry.operators.skew import PART, dealt, dense, in_parts, known_parts, laid_out, parts_of, placed, placed_of, ranked, salted_lookup
from webquarry.operators.stems import stems, with_stems
from webquarry.session import cut_lineage

# English function words that are no terms.
STOPWORDS = (
    "about above after again all also am an and another any are as at be because been before being below between both "
    "but by came can cannot come could did do does doing during each few for from further get got has had he have her "
    "here him himself his how if in into is it its itself like make many me might more most much must my myself never "
    "now of on only or other our ours ourselves out over own said same see should since so some still such take than "
    "that the their theirs them themselves then there these they this those through to too under until up very was way "
    "we well were what where when which while who whom with would why you your yours yourself a b c d e f g h i j k l m "
    "n o p q r s t u v w x y z $ 1 2 3 4 5 6 7 8 9 0 _"
).split()
THRESHOLD, TOP_SEGMENTS = 0.3, 10


def term_array(text: Column) -> Column:
    """Lower-case word tokens longer than two characters that are no stopwords, in order."""
    return F.filter(T.word_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, term."""
    return docs.select(key, F.posexplode(term_array(F.col(text))).alias("pos", "term"))


def stemmed_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, term: the stems of `tokens`."""
    return with_stems(tokens(docs, key, text), key, parts=parts_of(docs, text)).select(key, "pos", F.col("stem").alias("term"))


def vocabulary(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, first_doc, first_pos: distinct terms with where each is seen first.

    Sorting by (first_doc, first_pos) gives first-seen order; `indexed_vocabulary` numbers it.
    """
    return terms.groupBy("term").agg(F.min(F.struct(key, "pos")).alias("f")).select(
        "term", F.col(f"f.{key}").alias("first_doc"), F.col("f.pos").alias("first_pos")
    )


def indexed_vocabulary(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, index: a dense number from 0 on for every distinct term, in the order in which terms are first seen."""
    return ranked(vocabulary(terms, key), [F.col("first_doc"), F.col("first_pos")], "index").select("term", "index")


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, n, tf: count over document length (in terms).

    The texts are exchanged on the key; grouping by (key, term) and the total per key
    both follow that layout and need no further exchange.
    """
    parts = parts_of(docs, text)
    rows = docs.select(key, text)
    out = in_parts(_counted(laid_out(rows, key, parts), [key], text), parts)
    return placed(out, counted=_counted(dealt(rows, key, parts), [PART, key], text)) if parts and dense(docs) else out


def _counted(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    rows = docs.select(*by, term_array(F.col(text)).alias("ts")).select(*by, F.size("ts").alias("len"), F.explode("ts").alias("term"))
    counted = rows.groupBy(*by, "term").agg(F.count("*").alias("n"), F.first("len").alias("len"))
    return counted.select(*by, "term", "n", (F.col("n") / F.col("len")).alias("tf"))


def stemmed_frequencies(tf: DataFrame, key: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """key, term, n, tf of `term_frequencies`, where terms with one stem are one term.

    `known`: `counted_stems` of these terms, where they are at hand; else, where parts hold many documents, stems are found inside the parts.
    """
    parts = known_parts(tf)
    both = [F.sum("n").alias("n"), F.sum("tf").alias("tf")]
    here = placed_of(tf, "counted")
    if here is not None and known is None:
        found = with_stems(here, key).groupBy(PART, key, F.col("stem").alias("term")).agg(*both)
        return placed(in_parts(found.drop(PART), parts), stemmed=found)
    found = with_stems(tf, key, parts=parts, known=known)
    found = (laid_out(found, key, parts) if parts else found).groupBy(key, F.col("stem").alias("term"))
    return in_parts(found.agg(*both), parts)


def inverse_frequencies(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """term, df, idf = ln(N / df).  Counts are combined before the shuffle, so hot terms arrive reduced."""
    total = docs.agg(F.count("*")).scalar()
    idf = F.log(total / F.col("df")).alias("idf")
    here = placed_of(tf, "stemmed")
    if here is None:
        by_term = tf.groupBy("term").agg(F.count("*").alias("df"))
        return by_term.select("term", "df", idf)
    # A term is as many rows as it has parts.  The idf of the corpus and of the parts need the same columns of them, so they are exchanged once.
    by_part = here.where(F.col("term").isNotNull()).groupBy(PART, "term").agg(F.count("*").alias("n"))  # the join of `with_idf` would add this filter to one
    by_part = laid_out(by_part, "term", known_parts(tf))
    same = W.partitionBy("term")
    by_part = by_part.select(PART, "term", F.sum("n").over(same).alias("df"), F.min(PART).over(same).alias("first"))
    out = by_part.filter(F.col(PART) == F.col("first")).select("term", "df", idf)
    return placed(out, of=here, by_part=by_part.select(PART, "term", idf))


def with_idf(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """Every row gets the idf of its term.  A term found in a third of all rows, by its df, is spread over many tasks.

    Where both come from the same `dealt` rows, the idf of its terms is sent to each part instead, and the rows stay.
    """
    here = placed_of(tf, "stemmed")
    if here is not None and here is placed_of(idf, "of"):
        near = placed_of(idf, "by_part").repartitionById(known_parts(tf), F.col(PART))
        return here.join(near, ["term", PART]).drop(PART)
    return salted_lookup(tf, idf.select("term", "idf", "df"), "term", key, count="df", parts=known_parts(tf))


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """key, term, tf, idf, weight; of stems where `stemmed`."""
    tf = term_frequencies(docs, key, text)
    tf = stemmed_frequencies(tf, key) if stemmed else tf
    return with_idf(tf, inverse_frequencies(tf, docs), key).select(
        key, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight")
    )


def task_terms(task: str) -> dict[str, float]:
    """term -> tf of a task text.  The task is one sentence held by the driver."""
    found = [t for t in re.findall(r"[a-z0-9_]+", task.lower()) if len(t) > 2 and t not in STOPWORDS]
    return {t: found.count(t) / len(found) for t in dict.fromkeys(found)}


def task_stems(docs: DataFrame, task: str) -> dict[str, float]:
    """stem -> tf of a task text."""
    found = task_terms(task)
    rows = stems(docs.sparkSession.createDataFrame([(t,) for t in found], "term string")).collect()  # the words of one sentence
    stem = {r["term"]: r["stem"] for r in rows}
    out: dict[str, float] = {}
    for term, tf in found.items():
        out[stem[term]] = out.get(stem[term], 0.0) + tf
    return out


def _query_map(terms: dict[str, float]) -> Column:
    return F.create_map(*[x for t, w in terms.items() for x in (F.lit(t), F.lit(w))]) if terms else F.expr("cast(map() as map<string,double>)")


def _query_norm(idf: DataFrame, terms: dict[str, float]):
    """Length of the task vector, as a scalar subquery over its few terms."""
    q = F.try_element_at(_query_map(terms), F.col("term"))
    # A filter would go below the exchange of the parts' terms, which then is made again for these few.
    few = idf.filter(F.col("term").isin(list(terms))) if placed_of(idf, "by_part") is None else idf
    return few.agg(F.sqrt(F.sum(F.pow(q * F.col("idf"), 2)))).scalar()


def cosine_query(weights: DataFrame, idf: DataFrame, task: str, key: str = "doc_id", stemmed: bool = False) -> DataFrame:
    """key, similarity of every document to the task; 0 when a norm is 0.  `stemmed`: weights and idf are of stems.

    The task's terms are literals in the plan, so scoring is one aggregate, combined
    per partition before the exchange.
    """
    terms = task_stems(weights, task) if stemmed else task_terms(task)
    keys = key if isinstance(key, (list, tuple)) else [key]
    q = F.try_element_at(_query_map(terms), F.col("term"))
    sums = weights.groupBy(*keys).agg(
        F.sum(F.when(q.isNotNull(), F.col("weight") * q * F.col("idf")).otherwise(0.0)).alias("dot"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    norm = F.coalesce(_query_norm(idf, terms), F.lit(0.0))
    sums = sums.withColumn("qnorm", norm)
    sim = F.when((F.col("norm") > 0) & (F.col("qnorm") > 0), F.col("dot") / (F.col("norm") * F.col("qnorm"))).otherwise(0.0)
    return sums.select(*keys, sim.alias("similarity"))


def segment_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment, sentence."""
    return docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("segment", "sentence"))


def stem_forms(terms: DataFrame, wanted: list[str]) -> list[str]:
    """The distinct terms that have one of a task's stems: as few as the suffixes allow."""
    return [r["term"] for r in terms.filter(F.col("stem").isin(wanted)).select("term").collect()]


def segment_similarity(
    docs: DataFrame, idf: DataFrame, task: str, key: str = "doc_id", text: str = "text", stemmed: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """key, segment, similarity of the sentences that share a term with the task (all others have 0).

    Sentences without a task term leave before their terms are exploded; with stems, those without a term that has a stem of
    the task.  The others and the idf are read several times, so they are written first.  `known`: the stems of all terms of `docs`, where they are at hand.
    """
    wanted = list(task_stems(docs, task) if stemmed else task_terms(task))
    if stemmed:
        wanted = stem_forms(stems(tokens(docs, key, text)) if known is None else known, wanted)
    parts = parts_of(docs, text)
    rows = laid_out(docs.select(key, text), key, parts)
    rows = segment_rows(rows, key, text).select(key, "segment", term_array(F.col("sentence")).alias("ts"))
    rows = cut_lineage(rows.filter(F.arrays_overlap("ts", F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)))
    idf = cut_lineage(idf.select("term", "df", "idf"))
    rows = laid_out(rows, key, parts).select(key, "segment", F.size("ts").alias("len"), F.explode("ts").alias("term"))
    if stemmed:
        rows = laid_out(with_stems(rows, key, parts=parts).select(key, "segment", "len", F.col("stem").alias("term")), key, parts)
    tf = in_parts(rows.groupBy(key, "segment", "term").agg((F.count("*") / F.first("len")).alias("tf")), parts)
    here = tf.groupBy("term").agg(F.count("*").alias("df"))  # the task's terms are in all these sentences, so it is not the df of the corpus that tells which are spread
    weights = with_idf(tf, here.join(idf.drop("df"), "term"), key).withColumn("weight", F.col("tf") * F.col("idf"))
    return cosine_query(weights, idf, task, [key, "segment"], stemmed)


def top_segments(
    docs: DataFrame, idf: DataFrame, task: str, key: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, top: int = TOP_SEGMENTS, stemmed: bool = False, known: DataFrame | None = None,
) -> DataFrame:
    """key, segment, similarity, rank: the best sentences of each document at or above the threshold."""
    scored = segment_similarity(docs, idf, task, key, text, stemmed, known).filter(F.col("similarity") >= threshold)
    order = W.partitionBy(key).orderBy(F.desc(F.round("similarity", 12)), "segment")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)


def relevant_entities(
    docs: DataFrame, task: str | None, key: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, cap: int | None = None,
) -> DataFrame:
    """key (as page_id), entity columns, method: whole text, best segments, or patterns only without a task.

    No task words: pattern entities with confidence 0.5.  Document similar to the
    task: entities of the whole text, confidence = similarity.  Otherwise entities of
    the best segments, first occurrence kept, `cap` per document.

    Texts are exchanged raw, on their key, in as many tasks as they fill; similarities and the best segments come to them,
    so sentences are cut, scanned and deduplicated where their text is.
    """
    if not task or not task_terms(task):
        found = E.pattern_entities(docs, key, F.col(text), F.lit(0.5))
        return found.withColumnRenamed(key, "page_id").withColumn("method", F.lit("pattern_matching"))
    parts = parts_of(docs, text)
    tf = term_frequencies(docs, key, text)
    idf = cut_lineage(inverse_frequencies(tf, docs))  # read several times
    weights = with_idf(tf, idf, key).withColumn("weight", F.col("tf") * F.col("idf"))
    sims = cut_lineage(cosine_query(weights, idf, task, key))  # a number for each document, read several times
    scored = laid_out(docs.select(key, text), key, parts).join(laid_out(sims, key, parts), key, "left").na.fill({"similarity": 0.0})
    whole = E.pattern_entities(scored.filter(F.col("similarity") >= threshold), key, F.col(text), F.col("similarity"))
    rest = in_parts(scored.filter(F.col("similarity") < threshold), parts)
    best = top_segments(rest, idf, task, key, text, threshold)
    best = best.groupBy(key).agg(F.collect_list(F.struct("segment", "similarity", "rank")).alias("best"))  # TOP_SEGMENTS at most
    cut = rest.select(key, text).join(laid_out(best, key, parts), key).select(key, T.sentences(F.col(text)).alias("sentences"), "best")
    picked = cut.select(key, "sentences", F.explode("best").alias("b")).select(key, F.get("sentences", F.col("b.segment")).alias("sentence"), "b.similarity", "b.rank")
    picked = picked.filter(F.col("sentence").isNotNull())  # a key that comes twice has texts of several lengths
    pieces = E.pattern_entities(picked, key, F.col("sentence"), F.col("similarity"), order=F.col("rank"))
    pieces = E.dedup_entities(pieces.withColumnRenamed(key, "page_id"), cap)
    whole = whole.withColumnRenamed(key, "page_id")
    return whole.withColumn("method", F.lit("full_content")).unionByName(pieces.withColumn("method", F.lit("segments")))


# ---- dense vectors ------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    """Null when the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = magnitude(a) * magnitude(b)
    return F.when(size > 0, dot(a, b) / size).when(F.size(a) == F.size(b), F.lit(0.0))
