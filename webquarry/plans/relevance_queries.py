"""Registered queries over text relevance (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webquarry.functions import patterns as P
from webquarry.functions import text as T
from webquarry.operators import entities as E
from webquarry.operators import relevance as R
from webquarry.operators import stems as S
from webquarry.oracles import sql as O
from webquarry.plans.derived import read
from webquarry.plans.entity_queries import flat, pat_cte, plain
from webquarry.session import cut_lineage

TASK = "What about tion, ing or erst?"
STEM_TASK = "What about tioning, ings or ersts?"


def docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


def q_tokens(spark, sf):
    return R.tokens(docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


def q_vocabulary(spark, sf):
    return R.vocabulary(R.tokens(docs(spark, sf))).withColumn("first_pos", F.col("first_pos").cast("long"))


def q_vocabulary_index(spark, sf):
    return R.indexed_vocabulary(R.tokens(docs(spark, sf)))


def q_tf(spark, sf):
    return R.term_frequencies(docs(spark, sf)).withColumn("tf", F.round("tf", 9))


def q_idf(spark, sf):
    d = docs(spark, sf)
    return R.inverse_frequencies(R.term_frequencies(d), d).withColumn("idf", F.round("idf", 9))


def q_tfidf(spark, sf):
    return R.tfidf(docs(spark, sf)).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def q_cosine_query(spark, sf):
    d = docs(spark, sf)
    tf = R.term_frequencies(d)
    idf = R.inverse_frequencies(tf, d)
    weights = R.with_idf(tf, idf, "doc_id").withColumn("weight", F.col("tf") * F.col("idf"))
    scored = d.select("doc_id").join(R.cosine_query(weights, idf, TASK), "doc_id", "left").na.fill({"similarity": 0.0})  # without terms: 0
    return scored.withColumn("similarity", F.round("similarity", 9))


def q_stems(spark, sf):
    return S.stems(R.tokens(docs(spark, sf)))


def q_stemmed_tokens(spark, sf):
    return R.stemmed_tokens(docs(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


def q_stemmed_tfidf(spark, sf):
    return R.tfidf(docs(spark, sf), stemmed=True).select("doc_id", "term", F.round("weight", 9).alias("weight"))


def q_stemmed_cosine(spark, sf):
    d = docs(spark, sf)
    tf = R.stemmed_frequencies(R.term_frequencies(d))
    idf = R.inverse_frequencies(tf, d)
    weights = R.with_idf(tf, idf, "doc_id").withColumn("weight", F.col("tf") * F.col("idf"))
    scored = d.select("doc_id").join(R.cosine_query(weights, idf, STEM_TASK, stemmed=True), "doc_id", "left").na.fill({"similarity": 0.0})
    return scored.withColumn("similarity", F.round("similarity", 9))


def q_stemmed_segments(spark, sf):
    d = docs(spark, sf)
    tf = R.term_frequencies(d)
    known = cut_lineage(S.counted_stems(R.tokens(d)))
    idf = R.inverse_frequencies(R.stemmed_frequencies(tf, known=known), d)
    out = R.top_segments(d, idf, STEM_TASK, stemmed=True, known=known)
    return out.select("doc_id", F.col("segment").cast("long").alias("segment"), F.round("similarity", 9).alias("similarity"), "rank")


def q_vector_ops(spark, sf):
    a = F.col("embedding")
    rows = read(spark, sf, "embeddings").withColumn("other", F.reverse("embedding"))
    return rows.select(
        "vec_id", F.round(R.dot(a, F.col("other")), 9).alias("dot"), F.round(R.magnitude(a), 9).alias("magnitude"),
        F.round(R.cosine(a, F.col("other")), 9).alias("cosine"),
    )


def q_sentences(spark, sf):
    return R.segment_rows(docs(spark, sf)).withColumn("segment", F.col("segment").cast("long"))


def q_paragraphs(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def _idf(d):
    return R.inverse_frequencies(R.term_frequencies(d), d)


def q_top_segments(spark, sf):
    d = docs(spark, sf)
    out = R.top_segments(d, _idf(d), TASK)
    return out.select("doc_id", F.col("segment").cast("long").alias("segment"), F.round("similarity", 9).alias("similarity"), "rank")


def q_relevant_entities(spark, sf):
    return flat(R.relevant_entities(docs(spark, sf), TASK, threshold=0.2)).withColumnRenamed("page_id", "doc_id")


def q_all_entities(spark, sf):
    return flat(R.relevant_entities(docs(spark, sf), None)).withColumnRenamed("page_id", "doc_id")


QUERIES = {
    "tokens": q_tokens, "vocabulary": q_vocabulary, "vocabulary_index": q_vocabulary_index, "tf": q_tf, "idf": q_idf, "tfidf": q_tfidf, "cosine_query": q_cosine_query,
    "stems": q_stems, "stemmed_tokens": q_stemmed_tokens, "stemmed_tfidf": q_stemmed_tfidf, "stemmed_cosine": q_stemmed_cosine, "stemmed_segments": q_stemmed_segments,
    "vector_ops": q_vector_ops, "sentences": q_sentences, "paragraphs": q_paragraphs, "top_segments": q_top_segments,
    "relevant_entities": q_relevant_entities, "all_entities": q_all_entities,
}

# ---- SQL twins ----------------------------------------------------------------------------

STOP = ",".join(O.q(w) for w in R.STOPWORDS)


def terms(col):
    return f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9_]+'), lambda t: length(t) > 2 and t not in ({STOP}))"


SENT = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: {O.trim('s')}), lambda s: s <> '')"
TF = f"""ta as (select doc_id, {terms('text')} ts from documents),
tk as (select doc_id, len(ts) n_terms, unnest(ts) term from ta),
tf as (select doc_id, term, count(*) n, count(*) / max(n_terms) tf from tk group by 1, 2),
idf as (select term, count(*) df, ln((select count(*) from documents) / count(*)) idf from tf group by 1)"""
QT = "q as (select term, tf, idf, tf * idf qw from (values " + ", ".join(f"({O.q(t)}, {w!r}::double)" for t, w in R.task_terms(TASK).items()) + ") v(term, tf) join idf using (term))"
SIM = f"""{TF}, {QT}, qn as (select sqrt(sum(qw * qw)) qn from q),
sim as (select tf.doc_id, coalesce(sum(tf.tf * idf.idf * q.qw), 0) / nullif(sqrt(sum((tf.tf * idf.idf) ** 2)) * (select qn from qn), 0) s
  from tf join idf using (term) left join q using (term) group by 1)"""


def seg(source):
    return f"""sa as (select doc_id, {SENT} a from {source}), sb as (select doc_id, unnest(a) sentence, generate_subscripts(a, 1) - 1 segment from sa),
sc as (select doc_id, segment, {terms('sentence')} ts from sb), sd as (select doc_id, segment, len(ts) m, unnest(ts) term from sc),
st as (select doc_id, segment, term, count(*) / max(m) tf from sd group by 1, 2, 3),
ss as (select doc_id, segment, sum(st.tf * idf.idf * q.qw) / nullif(sqrt(sum((st.tf * idf.idf) ** 2)) * (select qn from qn), 0) s
   from st join idf using (term) left join q using (term) group by 1, 2)"""


def stem_steps(source: str) -> str:
    """Steps st0 .. st9 from the words of `source` (term) to (term, stem), one table for each."""
    m = "len(regexp_extract_all(x, '[aeiouy][^aeiouy]'))"
    short = "regexp_matches(x, '[^aeiouy][aeiouy][^aeiouywxY]$')"
    on = lambda condition, x: condition.replace("x,", f"{x},")
    voiced = "regexp_matches(x, '[aeiouy]')"
    out, n = [f"st0 as materialized (select term, regexp_replace(regexp_replace(term, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') w, false went from (select distinct term from {source}))"], 0

    def cut(rules):
        nonlocal n
        out.append(f"cut{n} as materialized (select term, w, went, regexp_extract(w, '({'|'.join(rules)})$', 1) suf, w[1:length(w) - length(suf)] pre from st{n})")

    def put(word, went="went"):
        nonlocal n
        out.append(f"st{n + 1} as materialized (select term, {word} w, {went} went from cut{n})")
        n += 1

    def swapped(rules):
        return "pre || case suf " + " ".join(f"when '{a}' then '{b}'" for a, b in rules.items()) + " end"

    def step(rules, condition):
        cut(rules)
        put(f"case when suf <> '' and ({condition}) then {swapped(rules)} else w end")

    step(S.PLURALS, "true")
    cut(S.ENDINGS)
    put(f"case when suf = 'eed' then case when {on(m, 'pre')} > 0 then pre || 'ee' else w end when suf <> '' and {on(voiced, 'pre')} then pre else w end",
        f"suf in ('ed', 'ing') and {on(voiced, 'pre')}")
    cut(S.REPAIRS)
    put(f"""case when not went then w when suf <> '' then {swapped(S.REPAIRS)}
  when length(w) > 1 and w[-1] = w[-2] and not regexp_matches(w, '[aeiouylsz]$') then w[1:length(w) - 1]
  when {on(m, 'w')} = 1 and {on(short, 'w')} then w || 'e' else w end""")
    step({"y": "i", "Y": "i"}, on(voiced, "pre"))
    step(S.DOUBLE_SUFFIXES, f"{on(m, 'pre')} > 0")
    step(S.FULL_SUFFIXES, f"{on(m, 'pre')} > 0")
    step(S.LAST_SUFFIXES, f"{on(m, 'pre')} > 1 and (suf <> 'ion' or pre[-1] in ('s', 't'))")
    step({"e": ""}, f"{on(m, 'pre')} > 1 or ({on(m, 'pre')} = 1 and not {on(short, 'pre')})")
    out.append(f"stem as materialized (select term, lower(case when {on(m, 'w')} > 1 and w like '%ll' then w[1:length(w) - 1] else w end) stem from st{n})")
    return ",\n".join(out)


def stem_task() -> str:
    """The task's terms by their stems, as rows (term, tf)."""
    rows = ", ".join(f"({O.q(t)}, {w!r}::double)" for t, w in R.task_terms(STEM_TASK).items())
    return f"qr(term, tf) as (values {rows})"


STEM_TK = f"""ta as (select doc_id, {terms('text')} ts from documents),
tk as (select doc_id, len(ts) n_terms, generate_subscripts(ts, 1) - 1 pos, unnest(ts) term from ta)"""
STEM_TF = f"""{stem_task()}, {STEM_TK}, known as (select term from tk union all select term from qr), {stem_steps('known')},
tf as (select doc_id, stem as term, count(*) / max(n_terms) tf from tk join stem using (term) group by 1, 2),
idf as (select term, ln((select count(*) from documents) / count(*)) idf from tf group by 1)"""
STEM_Q = f"""{STEM_TF}, q as (select stem as term, any_value(idf) idf, sum(tf) * any_value(idf) qw from qr join stem using (term) join idf on idf.term = stem group by 1),
qn as (select sqrt(sum(qw * qw)) qn from q)"""
STEM_SIM = f"""{STEM_Q}, sim as (select tf.doc_id, coalesce(sum(tf.tf * idf.idf * q.qw), 0) / nullif(sqrt(sum((tf.tf * idf.idf) ** 2)) * (select qn from qn), 0) s
  from tf join idf using (term) left join q using (term) group by 1)"""


def best(threshold):
    return f"""bs as (select doc_id, segment, s, row_number() over (partition by doc_id order by round(s, 12) desc, segment) rank from ss where s >= {threshold}
  qualify row_number() over (partition by doc_id order by round(s, 12) desc, segment) <= 10)"""


def ents(col, table, conf):
    """Pattern entities with their confidence and place."""
    return pat_cte(col, "doc_id", table, conf)


def _segment_entities():
    parts = []
    for i, (name, pattern) in enumerate(E.PATTERNS):
        pattern = plain(name, pattern)
        kind = {"email": "contact", "phone": "contact", "url": "custom", "price": "pricing", "company": "company", "date": "custom"}[name]
        data = {"price": "'price=' || v || ';value=' || regexp_replace(v, '[^0-9.]', '', 'g')", "company": "'name=' || v"}.get(
            name, f"case when '{name}' < 'type' then '{name}=' || v || ';type={name}' else 'type={name};{name}=' || v end")
        c = "s * 0.9" if name == "company" else "s"
        parts.append(f"select doc_id, '{kind}' as type, {data} as data, {c} conf, rank from (select doc_id, rank, s, unnest(regexp_extract_all(sentence, {O.q(pattern)})) v from ps)")
    return " union all ".join(parts)


ORACLE = {
    "stems": f"with {STEM_TK}, {stem_steps('tk')} select term, stem from stem",
    "stemmed_tokens": f"with {STEM_TK}, {stem_steps('tk')} select doc_id, pos, stem as term from tk join stem using (term)",
    "stemmed_tfidf": f"with {STEM_TF} select doc_id, term, round(tf * idf, 9) as weight from tf join idf using (term)",
    "stemmed_cosine": f"with {STEM_SIM} select doc_id, round(coalesce(s, 0), 9) as similarity from documents left join sim using (doc_id)",
    "stemmed_segments": f"""with {STEM_Q}, {seg('documents').replace("unnest(ts) term from sc)", "unnest(ts) raw from sc)").replace("st as (select doc_id, segment, term, count(*) / max(m) tf from sd group by 1, 2, 3)", "st as (select doc_id, segment, stem as term, count(*) / max(m) tf from sd join stem on stem.term = raw group by 1, 2, 3)")}, {best(0.3)}
select doc_id, segment, round(s, 9) as similarity, rank from bs""",
    "tokens": f"with a as (select doc_id, {terms('text')} ts from documents) select doc_id, generate_subscripts(ts, 1) - 1 as pos, unnest(ts) as term from a",
    "vocabulary": f"""with a as (select doc_id, {terms('text')} ts from documents), t as (select doc_id, generate_subscripts(ts, 1) - 1 pos, unnest(ts) term from a)
select term, doc_id as first_doc, pos as first_pos from t qualify row_number() over (partition by term order by doc_id, pos) = 1""",
    "vocabulary_index": f"""with a as (select doc_id, {terms('text')} ts from documents), t as (select doc_id, generate_subscripts(ts, 1) - 1 pos, unnest(ts) term from a),
f as (select term, doc_id, pos from t qualify row_number() over (partition by term order by doc_id, pos) = 1)
select term, row_number() over (order by doc_id, pos) - 1 as index from f""",
    "tf": f"with {TF} select doc_id, term, n, round(tf, 9) as tf from tf",
    "idf": f"with {TF} select term, df, round(idf, 9) as idf from idf",
    "tfidf": f"with {TF} select doc_id, term, round(tf * idf, 9) as weight from tf join idf using (term)",
    "cosine_query": f"with {SIM} select doc_id, round(coalesce(s, 0), 9) as similarity from documents left join sim using (doc_id)",
    "vector_ops": """with e as (select vec_id, embedding::double[] a, list_reverse(embedding)::double[] b from embeddings)
select vec_id, round(list_dot_product(a, b), 9) as dot, round(sqrt(list_dot_product(a, a)), 9) as magnitude,
round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) as cosine from e""",
    "sentences": f"with a as (select doc_id, {SENT} a from documents) select doc_id, generate_subscripts(a, 1) - 1 as segment, unnest(a) as sentence from a",
    "paragraphs": rf"""with a as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, {O.q(chr(92) + 'n' + P.PLAIN_WS + '*' + chr(92) + 'n')}), lambda s: {O.trim('s')}), lambda s: s <> '') a from documents)
select doc_id, generate_subscripts(a, 1) - 1 as pos, unnest(a) as paragraph from a""",
    "top_segments": f"with {SIM}, {seg('documents')}, {best(0.3)} select doc_id, segment, round(s, 9) as similarity, rank from bs",
    "relevant_entities": f"""with {SIM}, full_docs as (select d.doc_id, text, s as conf from documents d join sim using (doc_id) where coalesce(s, 0) >= 0.2),
rest as (select d.doc_id, text from documents d left join sim using (doc_id) where coalesce(s, 0) < 0.2), {seg('rest')}, {best(0.2)},
ps as (select bs.doc_id, bs.rank, bs.s, sb.sentence from bs join sb using (doc_id, segment)),
se as ({_segment_entities()})
select * from ({ents('text', 'full_docs', 'conf')}) union all
select doc_id, type, data, round(arg_min(conf, rank), 6), 'pattern_match' from se group by 1, 2, 3""",
    "all_entities": ents("text", "documents", "0.5"),
}
