"""Stems against a plain version that follows the definition letter by letter."""

import random

from webquarry.operators import relevance, stems


def consonant(w, i):
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))


def measure(w):
    shape = [consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(shape, shape[1:]))


def voiced(w):
    return any(not consonant(w, i) for i in range(len(w)))


def short(w):
    return len(w) > 2 and consonant(w, len(w) - 3) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 1) and w[-1] not in "wxy"


def by_rule(w, rules, holds):
    for suffix in sorted(rules, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + rules[suffix] if holds(stem, suffix) else w
    return w


def plain(w):
    if len(w) <= 2:
        return w
    w = by_rule(w, stems.PLURALS, lambda s, x: True)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                s = w[: -len(suffix)]
                if voiced(s):
                    w = s
                    if s[-2:] in stems.REPAIRS:
                        w = s + "e"
                    elif len(s) > 1 and s[-1] == s[-2] and consonant(s, len(s) - 1) and consonant(s, len(s) - 2) and s[-1] not in "lsz":
                        w = s[:-1]
                    elif measure(s) == 1 and short(s):
                        w = s + "e"
                break
    if w.endswith("y") and voiced(w[:-1]):
        w = w[:-1] + "i"
    w = by_rule(w, stems.DOUBLE_SUFFIXES, lambda s, x: measure(s) > 0)
    w = by_rule(w, stems.FULL_SUFFIXES, lambda s, x: measure(s) > 0)
    w = by_rule(w, stems.LAST_SUFFIXES, lambda s, x: measure(s) > 1 and (x != "ion" or s[-1:] in ("s", "t")))
    w = by_rule(w, {"e": ""}, lambda s, x: measure(s) > 1 or (measure(s) == 1 and not short(s)))
    return w[:-1] if measure(w) > 1 and w.endswith("ll") else w


KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam",
    "hopefulness": "hope", "triplicate": "triplic", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems_follow_the_definition(spark, sf_dir):
    draw = random.Random(8)
    tails = ["", *stems.PLURALS, *stems.ENDINGS, *stems.DOUBLE_SUFFIXES, *stems.FULL_SUFFIXES, *stems.LAST_SUFFIXES]
    made = {"".join(draw.choice("abcdeiloprstuyyz") for _ in range(draw.randrange(1, 7))) + draw.choice(tails) + draw.choice(tails) for _ in range(20_000)}
    made |= {"yyy", "ayyy", "syzygy", "_ing", "00ed", "ab", "a", "sayyid", "y", *KNOWN}
    rows = spark.createDataFrame([(t,) for t in [*made, *made, None]], "term string")
    got = {r.term: r.stem for r in stems.stems(rows).collect()}
    assert got == {t: plain(t) for t in made}
    assert {t: got[t] for t in KNOWN} == KNOWN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = stems.stems(relevance.tokens(docs)).collect()
    assert len(found) > 100 and all(r.stem == plain(r.term) for r in found)


def test_forms_of_a_word_are_one_term(spark):
    rows = [(1, "connect connected connecting"), (2, "connection lamps"), (3, "the of and"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tf = relevance.stemmed_frequencies(relevance.term_frequencies(docs))
    assert {(r.doc_id, r.term, r.n, round(r.tf, 9)) for r in tf.collect()} == {(1, "connect", 3, 1.0), (2, "connect", 1, 0.5), (2, "lamp", 1, 0.5)}
    assert relevance.task_stems(docs, "connecting connections lamps") == {"connect": 2 / 3, "lamp": 1 / 3}
    idf = relevance.inverse_frequencies(tf, docs)
    best = relevance.top_segments(docs, idf, "connects", stemmed=True).collect()
    assert {(r.doc_id, r.segment) for r in best} >= {(1, 0)}
    assert stems.stems(relevance.tokens(docs.where("doc_id = 4"))).count() == 0
