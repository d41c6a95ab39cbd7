"""Reference SQL (DuckDB dialect) for the registered queries.

Tables ``documents`` and ``labels`` are views over the same parquet files. Parameter
tables are inlined as VALUES from ``sources.fixtures`` so both sides share one list.
Rounding is floor(x * 10^d + 0.5) / 10^d on both sides.
"""

from __future__ import annotations

from trustlens import fixed_values as fv
from trustlens.operators import newton
from trustlens.sources import fixtures as fx

L = fx.ALPHABETS.score
CAPS = fx.ALPHABETS.capitals
WS = r"\s\x0b\x1c-\x1f"


def rnd(x: str, d: int) -> str:
    s = 10 ** d
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def D(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def toks(e: str, repl: str = "") -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '[^{L}{WS}]', '{repl}', 'g'), "
            f"'[{WS}]+'), lambda x: x <> '')")


def vtoks(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[\\pL\\pN_]{{2,}}')"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if not isinstance(v, (int, float)) or v is None else repr(v)
                                     for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


STOP = f"stop AS (SELECT token FROM {values([(w,) for w in fx.STOPWORDS], ['token'])})"
FORMS = f"fl AS (SELECT form, lemma FROM {values(fx.FORM_LEMMA, ['form', 'lemma'])})"
SEEDS = ("seeds AS (SELECT CAST(aspect_pos AS INTEGER) aspect_pos, aspect, seed FROM "
         + values([(i, a, s) for i, (a, ss) in enumerate(fx.ASPECT_SEEDS) for s in ss],
                  ["aspect_pos", "aspect", "seed"]) + ")")

CORPUS = """corpus AS (
  SELECT d.doc_id, d.lang AS language, d.text,
         CAST(CASE WHEN l.quality = 0 THEN 1.0 WHEN l.toxic = 1 THEN 3.0 ELSE 5.0 END AS DOUBLE) AS rating
  FROM documents d JOIN labels l USING (doc_id)),
sent AS (
  SELECT *, CASE WHEN rating IS NOT NULL AND NOT isnan(rating) AND rating >= 4 THEN 'positive'
                 WHEN rating IS NOT NULL AND NOT isnan(rating) AND rating <= 2 THEN 'negative'
                 ELSE 'neutral' END AS sentiment
  FROM corpus WHERE text IS NOT NULL),
sentl AS (
  SELECT *, CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 END AS INTEGER) AS label
  FROM sent)"""

SPLIT = f"""en AS (SELECT * FROM sentl WHERE language = '{fx.LANGUAGE}'),
pol AS (SELECT * FROM en WHERE sentiment IN ('positive', 'negative')),
spl AS (
  SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'train'
                 WHEN rn <= floor(n * 0.9::DOUBLE + 0.5::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hash, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n
        FROM (SELECT *, CAST(CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) AS BIGINT) AS hash
              FROM pol)))"""

LEMMAS = f"""{STOP}, {FORMS},
forms AS (
  SELECT doc_id, sentiment, unnest(f) AS form, CAST(unnest(range(0, len(f))) AS INTEGER) AS pos
  FROM (SELECT doc_id, sentiment, {toks('text', ' ')} AS f FROM en)),
lem0 AS (
  SELECT doc_id, sentiment, pos, coalesce(fl.lemma, form) AS lemma
  FROM forms LEFT JOIN fl USING (form)
  WHERE length(form) >= 3 AND form NOT IN (SELECT token FROM stop)),
lem AS (SELECT * FROM lem0 WHERE length(lemma) >= 3 AND lemma NOT IN (SELECT token FROM stop)),
cnt AS (SELECT sentiment, lemma, count(*) AS n FROM lem
        WHERE sentiment IN ('positive', 'negative') GROUP BY sentiment, lemma),
cand AS (SELECT lemma, CAST(sum(n) AS BIGINT) AS n FROM cnt GROUP BY lemma
         ORDER BY n DESC, lemma LIMIT {fv.CANDIDATE_POOL_SIZE}),
{SEEDS},
dict AS (SELECT aspect_pos, aspect, seed AS term FROM seeds
         UNION SELECT s.aspect_pos, s.aspect, c.lemma FROM cand c JOIN seeds s
               ON contains(c.lemma, substr(s.seed, 1, {fv.SEED_ROOT_CHARS}))),
hits AS (SELECT DISTINCT l.doc_id, d.aspect_pos, d.aspect FROM lem l JOIN dict d ON l.lemma = d.term),
tags AS (SELECT e.doc_id, coalesce(h.tags, '{fx.ASPECT_CLASSES[-1]}') AS tags FROM en e LEFT JOIN
           (SELECT doc_id, string_agg(aspect, ',' ORDER BY aspect_pos) AS tags FROM hits GROUP BY doc_id) h
         USING (doc_id))"""

LEXICON = f"""lab AS (SELECT d.doc_id, l.quality, l.toxic, d.text FROM documents d JOIN labels l USING (doc_id)
         WHERE d.text IS NOT NULL),
pn AS (SELECT sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS cls_pos,
              sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS cls_neg FROM lab),
lt AS (SELECT DISTINCT * FROM (SELECT doc_id, quality, toxic, unnest({toks('text')}) AS term FROM lab)),
lcnt AS (SELECT term, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS p,
                sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS n
         FROM lt GROUP BY term HAVING sum(CASE WHEN quality IN (0, 1) THEN 1 ELSE 0 END) >= 5),
lex AS (SELECT term, (p / cls_pos - n / cls_neg) / (p / cls_pos + n / cls_neg) AS value FROM lcnt, pn),
lexr AS (SELECT term, CASE WHEN value > 0 THEN 'PSTV' WHEN value < 0 THEN 'NGTV' ELSE 'NEUT' END AS tag,
                value FROM lex)"""

DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _length(t="text"):
    n = f"len(regexp_extract_all({t}, '[^{WS}]+'))"
    return (f"CAST(CASE WHEN {n} < 5 THEN {n} / 5 WHEN {n} > 300 THEN greatest(0, 1 - ({n} - 300) / 300) "
            f"ELSE 1 END AS DOUBLE)")


def _diversity(w="w"):
    n = f"len({w})"
    win = f"list_transform(range(0, {n} - 19, 10), lambda i: len(list_distinct({w}[i + 1:i + 20])) / 20)"
    return (f"CAST(CASE WHEN {n} < 3 THEN 0 WHEN {n} <= 20 THEN len(list_distinct({w})) / {n} "
            f"ELSE list_reduce({win}, lambda a, b: a + b) / len({win}) END AS DOUBLE)")


def _quality(t="text"):
    ln = f"length({t})"
    letters = f"length(regexp_replace({t}, '[^{L}]', '', 'g'))"
    caps = f"length(regexp_replace({t}, '[^{CAPS}]', '', 'g'))"
    ch = f"regexp_extract_all({t}, '(?s).')"
    rep = (f"len(list_filter(range(1, len(ch) + 1), lambda i: (i = 1 OR ch[i] <> ch[i - 1]) AND ch[i] <> chr(10) "
           f"AND ch[i + 1] = ch[i] AND ch[i + 2] = ch[i] AND ch[i + 3] = ch[i]))")
    p1 = f"least({letters} / greatest({ln}, 1) / {D(0.6)}, 1)"
    p2 = f"greatest(0, 1 - {rep} * {D(0.2)})"
    p3 = f"CASE WHEN regexp_matches({t}, 'http|www\\.|@') THEN {D(0.3)} ELSE 1 END"
    p4 = f"greatest(0, 1 - greatest(0, {caps} / greatest({letters}, 1) - {D(0.4)}) * 3)"
    return (f"CAST(CASE WHEN {ln} < 2 THEN 0 ELSE ((({p1} + {p2}) + {p3}) + {p4}) / 4 END AS DOUBLE)", ch)


def _emotion(hits="hits", mean="mean", std="std"):
    return (f"CASE WHEN {hits} IS NULL OR {hits} < 3 THEN {D(0.5)} ELSE greatest(0, least(1, "
            f"1 - abs({mean}) * (1 - least({std}, {D(0.5)}) / {D(0.5)}))) END")


SIGNALS = f"""{LEXICON}, {DOCS},
sig0 AS (SELECT doc_id, text, {_length()} AS length, {toks('text')} AS w,
                {_quality()[1]} AS ch FROM docs),
sig1 AS (SELECT doc_id, text, length, {_diversity()} AS diversity, {_quality()[0]} AS quality FROM sig0),
emo AS (SELECT doc_id, count(*) AS hits, avg(value) AS mean, stddev_pop(value) AS std
        FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM docs) JOIN lexr USING (term)
        GROUP BY doc_id)"""

TFIDF = f"""post AS (SELECT doc_id, term, count(*) AS tf
         FROM (SELECT doc_id, unnest({vtoks('text')}) AS term FROM docs) GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM docs),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM post GROUP BY term),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY cf DESC, term) - 1 AS INTEGER) AS idx, cf, df,
                 ln((1 + n) / (1 + df)) + 1 AS idf
          FROM stats, nd ORDER BY cf DESC, term LIMIT {fv.VOCABULARY_SIZE}),
wts AS (SELECT p.doc_id, p.term, v.idx, p.tf * v.idf AS w FROM post p JOIN vocab v USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM wts GROUP BY doc_id),
uv AS (SELECT doc_id, term, idx, w / nrm AS w FROM wts JOIN nrm USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, sum(a.w * b.w) AS s FROM uv a JOIN uv b ON a.idx = b.idx AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id),
mx AS (SELECT a AS doc_id, max(s) AS max_sim FROM pairs GROUP BY a),
sim AS (SELECT doc_id, CASE WHEN m > {D(0.85)} THEN m END AS max_sim,
               {rnd(f"CASE WHEN m > {D(0.85)} THEN greatest(0, least(1, 1 - (m - {D(0.85)}) / ({D(1.0)} - {D(0.85)}))) ELSE 1 END", 6)} AS similarity
        FROM (SELECT d.doc_id, {rnd('coalesce(mx.max_sim, 0)', 6)} AS m FROM docs d LEFT JOIN mx USING (doc_id)))"""


def _keys():
    return ([("sentiment", c) for c in fx.SENTIMENT_CLASSES] + [("aspect", c) for c in fx.ASPECT_CLASSES])


def _head(coefficients=fx.COEFS):
    keys = _keys()
    kcase = "CASE " + " ".join(f"WHEN head = {q(h)} AND class = {q(c)} THEN {n}" for n, (h, c) in enumerate(keys)) + " END"
    coefs = values(coefficients, ["head", "class", "term", "coef"])
    zs = []
    for n in range(len(keys)):
        bias = sum(c for h, k, t, c in coefficients if t is None and (h, k) == keys[n])
        zs.append(f"CAST(coalesce(sum(CASE WHEN k = {n} THEN CAST(round(coef * 1000000000) AS BIGINT) END), 0) "
                  f"+ {int(round(bias * 10 ** 9))} AS BIGINT) AS z{n}")
    off = len(fx.SENTIMENT_CLASSES)
    asp_rows = values([(a, name) for a, name in enumerate(fx.ASPECT_CLASSES)], ["apos", "aname"])
    pcase = "CASE " + " ".join(f"WHEN apos = {a} THEN 1 / (1 + exp(-(z{off + a} / 1000000000.0::DOUBLE)))"
                               for a in range(len(fx.ASPECT_CLASSES))) + " END"
    return f"""cw AS (SELECT term, coef, {kcase} AS k FROM {coefs} WHERE term IS NOT NULL),
htok AS (SELECT doc_id, unnest({toks('text')}) AS term FROM docs),
hz0 AS (SELECT d.doc_id, t.term, cw.k, cw.coef FROM docs d
        LEFT JOIN (htok t JOIN cw USING (term)) ON d.doc_id = t.doc_id),
hz AS (SELECT doc_id, {', '.join(zs)} FROM hz0 GROUP BY doc_id),
hp AS (SELECT doc_id, 1 / (1 + exp((z0 - z1) / 1000000000.0::DOUBLE)) AS p_pos,
              1 / (1 + exp((z1 - z0) / 1000000000.0::DOUBLE)) AS p_neg, * EXCLUDE (doc_id)
       FROM hz),
ha AS (SELECT doc_id, apos, aname, {pcase} AS p FROM hp, {asp_rows}),
hl AS (SELECT doc_id, string_agg(aname, ', ' ORDER BY p DESC, apos DESC)
                      FILTER (WHERE p > {D(fv.ASPECT_THRESHOLD)} AND aname <> {q(fx.ASPECT_CLASSES[-1])}) AS al
       FROM ha GROUP BY doc_id),
head AS (SELECT doc_id, CASE WHEN p_pos > 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
                {rnd('p_pos', 6)} AS p_positive, {rnd('greatest(p_pos, p_neg) * 100', 1)} AS confidence_pct,
                coalesce(al, '{fv.NO_ASPECTS}') AS aspects
         FROM hp JOIN hl USING (doc_id))"""


def _trust(sim_expr):
    t = (f"((((length * {D(0.15)} + diversity * {D(0.25)}) + emotion * {D(0.25)}) + quality * {D(0.2)})"
         f" + {sim_expr} * {D(0.15)}) * 100")
    return rnd(t, 1)


TRUST = lambda sim_join, sim_expr: f"""trust AS (
  SELECT s.doc_id, s.text, {_trust(sim_expr)} AS trust_score,
         {rnd('length * 100', 1)} AS trust_length, {rnd('diversity * 100', 1)} AS trust_diversity,
         {rnd('emotion * 100', 1)} AS trust_emotion, {rnd('quality * 100', 1)} AS trust_quality,
         {rnd(f'{sim_expr} * 100', 1)} AS trust_similarity
  FROM (SELECT s.*, {_emotion()} AS emotion FROM sig1 s LEFT JOIN emo USING (doc_id)) s {sim_join})"""

SCORED = f"""{SIGNALS}, {TFIDF}, {_head()},
{TRUST('LEFT JOIN sim USING (doc_id)', 'coalesce(sim.similarity, 1)')},
scored AS (SELECT t.doc_id, t.text, h.sentiment, h.confidence_pct, h.aspects, t.trust_score, t.trust_length,
                  t.trust_diversity, t.trust_emotion, t.trust_quality, t.trust_similarity
           FROM trust t LEFT JOIN head h USING (doc_id))"""

# the similarity column of the scored batch uses the unrounded score in Spark; the
# rounded score (6 dp) equals it up to the last digit, which rounding to 1 dp hides


def _ymh():
    return ", ".join(f"CAST(list_contains(string_split(tags, ','), {q(c)}) AS INTEGER) AS y{i}"
                     for i, c in enumerate(fx.ASPECT_CLASSES))


def oracle_sql() -> dict[str, str]:
    S = {}
    S["rating_sentiment"] = f"WITH {CORPUS} SELECT doc_id, language, rating, sentiment, label FROM sentl"
    S["split_assignment"] = f"WITH {CORPUS}, {SPLIT} SELECT doc_id, label, hash, split FROM spl"
    S["class_counts"] = (f"WITH {CORPUS}, {SPLIT} SELECT label, count(*) AS n, {rnd('1 / count(*)', 9)} AS weight "
                         f"FROM spl WHERE split = 'train' GROUP BY label")
    S["train_weights"] = (f"WITH {CORPUS}, {SPLIT}, tr AS (SELECT * FROM spl WHERE split = 'train'), "
                          f"cw AS (SELECT label, count(*) AS n FROM tr GROUP BY label) "
                          f"SELECT tr.doc_id, tr.label, {rnd('1 / cw.n', 9)} AS weight FROM tr JOIN cw USING (label)")
    S["clean_lemmas"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT doc_id, pos, lemma FROM lem"
    S["lemma_counts_by_class"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT sentiment, lemma, n FROM cnt"
    S["candidate_terms"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT lemma, n FROM cand"
    S["frequent_lemmas"] = S["candidate_terms"]
    S["aspect_dictionary"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT aspect_pos, aspect, term FROM dict"
    S["aspect_dictionary_full"] = (f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT aspect_pos, aspect, seed AS term FROM seeds UNION "
                                   f"SELECT s.aspect_pos, s.aspect, c.lemma FROM (SELECT DISTINCT lemma FROM cnt) c JOIN seeds s "
                                   f"ON contains(c.lemma, substr(s.seed, 1, {fv.SEED_ROOT_CHARS}))")
    S["learned_lemmas"] = _learned()
    S["aspect_tags"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT doc_id, tags FROM tags"
    S["aspect_multihot"] = f"WITH {CORPUS}, {SPLIT}, {LEMMAS} SELECT doc_id, {_ymh()} FROM tags"
    S["lexicon_table"] = f"WITH {LEXICON} SELECT term, tag, value FROM lexr"
    S["lexicon_dedup"] = f"""WITH {LEXICON},
tox AS (SELECT term, count(*) AS t FROM lt WHERE toxic = 1 GROUP BY term HAVING count(*) >= 2),
raw AS (SELECT 0 AS pos, term, tag, value FROM lexr
        UNION ALL SELECT 1 AS pos, term, 'NGTV' AS tag, -t / (t + 1) AS value FROM tox JOIN lexr USING (term))
SELECT term, max_by(tag, pos) AS tag, max_by(value, pos) AS value FROM raw GROUP BY term"""
    S["score_length"] = f"WITH {DOCS} SELECT doc_id, {rnd(_length(), 9)} AS length FROM docs"
    S["score_diversity"] = (f"WITH {DOCS} SELECT doc_id, {rnd(_diversity(), 9)} AS diversity FROM "
                            f"(SELECT doc_id, {toks('text')} AS w FROM docs)")
    S["score_quality"] = (f"WITH {DOCS} SELECT doc_id, {rnd(_quality()[0], 9)} AS quality FROM "
                          f"(SELECT doc_id, text, {_quality()[1]} AS ch FROM docs)")
    S["score_emotion"] = (f"WITH {SIGNALS} SELECT d.doc_id, coalesce(hits, 0) AS hits, "
                          f"{rnd(_emotion(), 9)} AS emotion FROM docs d LEFT JOIN emo USING (doc_id)")
    S["tfidf_vocabulary"] = f"WITH {DOCS}, {TFIDF} SELECT term, idx, cf, df, {rnd('idf', 9)} AS idf FROM vocab"
    S["tfidf_weights"] = f"WITH {DOCS}, {TFIDF} SELECT doc_id, term, {rnd('w', 9)} AS weight FROM uv"
    S["frequent_vocabulary"] = S["tfidf_vocabulary"]
    S["similarity_score"] = f"WITH {DOCS}, {TFIDF} SELECT doc_id, max_sim, similarity FROM sim"
    S["similarity_recall"] = f"WITH {DOCS}, {TFIDF} SELECT count(max_sim) AS near, true AS recall_enough, true AS none_beyond FROM sim"
    S["linear_head_scores"] = (f"WITH {DOCS}, {_head()} SELECT doc_id, sentiment, p_positive, confidence_pct, "
                               f"aspects FROM head")
    S["trust_score"] = (f"WITH {SIGNALS}, {TFIDF}, {TRUST('LEFT JOIN sim USING (doc_id)', 'coalesce(sim.similarity, 1)')} "
                        f"SELECT doc_id, trust_score, trust_length, trust_diversity, trust_emotion, trust_quality, "
                        f"trust_similarity FROM trust")
    S["scored_batch"] = f"WITH {SCORED} SELECT * FROM scored"
    S["single_review"] = f"""WITH {SIGNALS}, {_head()}, {TRUST('', '1')}
SELECT t.doc_id, h.sentiment, h.confidence_pct, h.aspects, t.trust_score,
       CASE WHEN t.trust_score <= 1 THEN t.trust_score * 100 ELSE t.trust_score END AS trust_display,
       CASE WHEN (CASE WHEN t.trust_score <= 1 THEN t.trust_score * 100 ELSE t.trust_score END) > 50
            THEN 'safe' ELSE 'suspicious' END AS verdict
FROM trust t LEFT JOIN head h USING (doc_id)"""
    share = lambda k: f"CASE WHEN count(*) > 0 THEN {rnd(f'{k} * 100 / count(*)', 2)} ELSE 0 END"
    S["report_kpis"] = f"""WITH {SCORED}
SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE trust_score < 50) AS suspicious,
       {share("count(*) FILTER (WHERE sentiment = 'positive')")} AS positive_pct,
       {share("count(*) FILTER (WHERE sentiment = 'negative')")} AS negative_pct,
       {share("count(*) FILTER (WHERE trust_score < 50)")} AS suspicious_pct,
       {rnd('coalesce(avg(trust_score), 0)', 6)} AS mean_trust
FROM scored"""
    S["aspect_mentions"] = f"""WITH {DOCS}, {_head()},
m AS (SELECT trim(a) AS aspect, count(*) AS mentions FROM (SELECT unnest(string_split(aspects, ',')) AS a FROM head)
      WHERE trim(a) <> '{fv.NO_ASPECTS}' AND trim(a) <> '' GROUP BY trim(a))
SELECT aspect, mentions, CAST(row_number() OVER (ORDER BY mentions DESC, aspect) AS INTEGER) AS rank FROM m"""
    S["suspicious"] = (f"WITH {SCORED} SELECT doc_id, trust_score, substr(text, 1, 80) AS preview FROM scored "
                       f"WHERE trust_score < 50 ORDER BY trust_score, doc_id")
    S["detail"] = (f"WITH {SCORED} SELECT doc_id, CASE WHEN trust_score < 50 THEN 'suspicious' ELSE 'ok' END AS flag, "
                   f"sentiment, confidence_pct, trust_score, aspects, substr(text, 1, 80) AS preview FROM scored")
    S["health_kpis"] = f"""WITH {SCORED},
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
             count(*) FILTER (WHERE trust_score < 50) AS spam, coalesce(avg(confidence_pct), 0) AS avg_conf
      FROM scored),
b AS (SELECT *, total - positive AS negative,
             CASE WHEN total > 0 THEN positive / total ELSE 0 END AS pos_share,
             CASE WHEN total > 0 THEN (total - positive) / total ELSE 0 END AS neg_share,
             CASE WHEN total > 0 THEN spam / total ELSE 0 END AS spam_share FROM a),
c AS (SELECT total, positive, negative, spam, {rnd('pos_share', 6)} AS pos_share, {rnd('neg_share', 6)} AS neg_share,
             {rnd('spam_share', 6)} AS spam_share, {rnd('(1 - spam_share) * 100', 6)} AS health_pct,
             {rnd('avg_conf', 6)} AS avg_confidence_pct,
             CASE WHEN pos_share >= neg_share THEN 'positive' ELSE 'negative' END AS dominant FROM b)
SELECT *, CASE WHEN health_pct >= 80 THEN 'no_spam' WHEN health_pct >= 50 THEN 'moderate' ELSE 'high_spam' END AS band
FROM c"""
    S["map_scored"] = S["linear_head_scores"]
    S["csv_roundtrip"] = (f"WITH {SCORED} SELECT * REPLACE ({_awkward()} AS text) FROM scored "
                          "UNION ALL SELECT * REPLACE (-1 - doc_id AS doc_id, '' AS text) FROM scored WHERE doc_id % 8 = 4")
    S["marked_csv"] = S["csv_roundtrip"]
    S["reviews_csv_scan"] = (f"SELECT doc_id, {_awkward()} AS text FROM documents "
                             "UNION ALL SELECT -1 - doc_id, '' FROM documents WHERE doc_id % 8 = 4")
    S["drawn_training_set"] = f"""WITH {CORPUS}, {SPLIT},
tr AS (SELECT doc_id, label, hash, 1099511627776 // count(*) OVER (PARTITION BY label) AS units FROM spl WHERE split = 'train'),
iv AS (SELECT *, CAST(sum(units) OVER (ORDER BY hash, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM tr),
dr AS (SELECT r.draw, CAST(CAST('0x' || substr(md5('42:draw:' || CAST(r.draw AS VARCHAR)), 1, 15) AS UBIGINT) AS BIGINT) % t.total AS place
       FROM (SELECT unnest(range(0, (SELECT count(*) FROM tr))) AS draw) r, (SELECT max(hi) AS total FROM iv) t)
SELECT draw, doc_id, label FROM dr JOIN iv ON place >= hi - units AND place < hi"""
    S["newton_heads"] = _newton(S)
    S["shown_trust"] = f"""WITH {SCORED}, f AS (SELECT doc_id, trust_score, {rnd('trust_score / 100', 6)} AS fraction FROM scored)
SELECT doc_id, CASE WHEN max(trust_score) OVER () <= 1 THEN trust_score * 100 ELSE trust_score END AS shown,
       {rnd('CASE WHEN max(fraction) OVER () <= 1 THEN fraction * 100 ELSE fraction END', 6)} AS shown_of_fractions FROM f"""
    S["aspect_overlap"] = f"""WITH {CORPUS}, {SPLIT}, {LEMMAS},
direct AS (SELECT DISTINCT l.doc_id, s.aspect_pos, s.aspect FROM lem l JOIN seeds s ON l.lemma = s.seed)
SELECT e.doc_id, coalesce(string_agg(d.aspect, ',' ORDER BY d.aspect_pos), '{fx.ASPECT_CLASSES[-1]}') AS tags
FROM en e LEFT JOIN direct d ON d.doc_id = e.doc_id GROUP BY e.doc_id"""
    S["reviews_by_place"] = (f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, {_awkward()} AS text "
                             "FROM documents WHERE text IS NOT NULL")
    S["corpus_csv_scan"] = f"WITH {CORPUS} SELECT doc_id, language, text, rating FROM corpus"
    S["lexicon_roundtrip"] = S["lexicon_dedup"]
    S["class_order_roundtrip"] = ("SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS INTEGER) AS class_pos, "
                                  "lang AS class FROM documents GROUP BY lang")
    S["report"] = f"""WITH {SCORED},
k AS ({S["report_kpis"].split("WITH " + SCORED)[1]}),
m AS (SELECT trim(a) AS aspect, count(*) AS mentions FROM (SELECT unnest(string_split(aspects, ',')) AS a FROM scored)
      WHERE trim(a) <> '—' AND trim(a) <> '' GROUP BY trim(a))
SELECT 'kpis' AS section, item, CAST(value AS DOUBLE) AS value
FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM k) ON COLUMNS(*) INTO NAME item VALUE value)
UNION ALL SELECT 'mentions', aspect, CAST(mentions AS DOUBLE) FROM m
UNION ALL SELECT 'suspicious', CAST(doc_id AS VARCHAR), trust_score FROM scored WHERE trust_score < 50
UNION ALL SELECT 'detail', CASE WHEN trust_score < 50 THEN 'suspicious' ELSE 'ok' END, CAST(count(*) AS DOUBLE) FROM scored GROUP BY 2"""
    S["train_contract"] = f"""WITH {CORPUS}, {SPLIT}
SELECT label, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
       count(*) FILTER (WHERE split = 'test') AS n_test, 3 AS candidates, true AS counts_add_up, true AS first_best_chosen,
       true AS reloaded_same
FROM spl GROUP BY label"""
    S["model_selection"] = f"""WITH f AS ({" UNION ALL ".join(
        f"SELECT {v} AS candidate, f1_positive, accuracy FROM ({_evaluated(fx.variant(v))})" for v in range(len(fx.VARIANTS)))})
SELECT *, candidate = (SELECT min(candidate) FROM f WHERE f1_positive = (SELECT max(f1_positive) FROM f)) AS chosen FROM f"""
    S["eval_metrics"] = _evaluated(fx.COEFS)
    return S


def _learned() -> str:
    """Lemmas of ``LEMMAS``' forms, unknown ones by the longest suffix (1 to 4 characters) with a rule."""
    return f"""WITH {CORPUS}, {SPLIT}, {LEMMAS},
taught AS (SELECT right(form, k) AS suffix, substr(lemma, length(form) - k + 1) AS ending
           FROM fl, (SELECT unnest(range(1, 5)) AS k)
           WHERE k < length(form) AND length(lemma) >= length(form) - k
             AND substr(form, 1, length(form) - k) = substr(lemma, 1, length(form) - k)),
rules AS (SELECT suffix, ending FROM (SELECT suffix, ending, row_number() OVER (PARTITION BY suffix ORDER BY count(*) DESC, ending) AS r
                                      FROM taught GROUP BY suffix, ending) WHERE r = 1),
words AS (SELECT DISTINCT form FROM forms WHERE length(form) >= 3 AND form NOT IN (SELECT token FROM stop)),
guess AS (SELECT form, max_by(substr(form, 1, length(form) - length(suffix)) || ending, length(suffix)) AS lemma
          FROM words JOIN rules ON suffix = right(form, length(suffix)) AND length(suffix) < length(form) GROUP BY form)
SELECT doc_id, pos, lemma FROM (
  SELECT f.doc_id, f.pos, coalesce(fl.lemma, g.lemma, f.form) AS lemma
  FROM forms f JOIN words USING (form) LEFT JOIN fl ON fl.form = f.form LEFT JOIN guess g ON g.form = f.form)
WHERE length(lemma) >= 3 AND lemma NOT IN (SELECT token FROM stop)"""


def _newton(S: dict[str, str]) -> str:
    """The grouped sums and Newton steps of ``newton_heads``, step by step; the 3 x 3 system by determinants."""
    heads = ["SELECT 'sentiment' AS head, label AS y, x1, x2 FROM rows_"]
    heads += [f"SELECT {q(a)}, y{i}, x1, x2 FROM rows_" for i, a in enumerate(fx.ASPECT_CLASSES)]
    body = f"""WITH dv AS ({S["score_diversity"]}), ql AS ({S["score_quality"]}), mh AS ({S["aspect_multihot"]}), sp AS ({S["split_assignment"]}),
rows_ AS (SELECT label, {rnd('diversity', 2)} AS x1, {rnd('quality', 2)} AS x2, mh.* EXCLUDE (doc_id)
          FROM sp JOIN dv USING (doc_id) JOIN ql USING (doc_id) JOIN mh USING (doc_id) WHERE split = 'train'),
cells AS (SELECT head, x1, x2, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM ({' UNION ALL '.join(heads)}) GROUP BY head, x1, x2),
w0 AS (SELECT DISTINCT head, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM cells)"""
    for k in range(1, newton.STEPS + 1):
        body += f""",
s{k} AS MATERIALIZED (
  SELECT head, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
         sum(v) + {newton.PENALTY} AS a, sum(v * x1) AS b, sum(v * x2) AS c, sum(v * x1 * x1) + {newton.PENALTY} AS d, sum(v * x1 * x2) AS e,
         sum(v * x2 * x2) + {newton.PENALTY} AS f, sum(r) - any_value(b0) * {newton.PENALTY} AS g0, sum(r * x1) - any_value(b1) * {newton.PENALTY} AS g1,
         sum(r * x2) - any_value(b2) * {newton.PENALTY} AS g2
  FROM (SELECT *, n * p * (1 - p) AS v, pos - n * p AS r
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM cells JOIN w{k - 1} USING (head))) GROUP BY head),
w{k} AS MATERIALIZED (
  SELECT head, b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0,
         b1 + (a * (g1 * f - e * g2) - g0 * (b * f - c * e) + c * (b * g2 - g1 * c)) / det AS b1,
         b2 + (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s{k}))"""
    return body + f"""
SELECT head, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, {rnd('any_value(b0)', 6)} AS intercept,
       {rnd('any_value(b1)', 6)} AS w_diversity, {rnd('any_value(b2)', 6)} AS w_quality
FROM cells JOIN w{newton.STEPS} USING (head) GROUP BY head"""


def _awkward() -> str:
    return ("CASE doc_id % 8 WHEN 0 THEN '  ' || text WHEN 1 THEN text || '  ' WHEN 2 THEN '\"' || text || '\"' "
            "WHEN 3 THEN chr(10) || text || chr(10) WHEN 5 THEN ',;' || chr(9) || text ELSE text END")


def _evaluated(coefficients) -> str:
    return f"""WITH {CORPUS}, {SPLIT}, {LEMMAS}, docs AS (SELECT doc_id, text FROM pol), {_head(coefficients)},
ev AS (SELECT h.doc_id, p.label, CASE WHEN h.sentiment = 'positive' THEN 1 ELSE 0 END AS pred
       FROM head h JOIN pol p USING (doc_id)),
b AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM ev),
am AS (SELECT CASE WHEN p > {D(fv.ASPECT_THRESHOLD)} THEN 1 ELSE 0 END AS pr,
              CASE WHEN list_contains(string_split(tags, ','), aname) THEN 1 ELSE 0 END AS t
       FROM ha JOIN tags USING (doc_id)),
m AS (SELECT sum(CASE WHEN t = 1 AND pr = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN t = 0 AND pr = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN t = 1 AND pr = 0 THEN 1 ELSE 0 END) AS fn FROM am)
SELECT b.n, b.tp, b.fp, b.fn, b.tn,
       CASE WHEN 2 * b.tp + b.fp + b.fn > 0 THEN {rnd('2 * b.tp / (2 * b.tp + b.fp + b.fn)', 9)} ELSE 0 END AS f1_positive,
       CASE WHEN 2 * b.tn + b.fn + b.fp > 0 THEN {rnd('2 * b.tn / (2 * b.tn + b.fn + b.fp)', 9)} ELSE 0 END AS f1_negative,
       CASE WHEN b.n > 0 THEN {rnd('(b.tp + b.tn) / b.n', 9)} ELSE 0 END AS accuracy,
       CASE WHEN 2 * m.tp + m.fp + m.fn > 0 THEN {rnd('2 * m.tp / (2 * m.tp + m.fp + m.fn)', 9)} ELSE 0 END
         AS aspect_micro_f1
FROM b, m"""
