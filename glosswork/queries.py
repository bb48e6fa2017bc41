"""Driver queries over the token tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import case, rules
from .operators import tagger, tokens as tok

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input's files and row groups give fewer partitions than there
    are cores; a larger input has more of them and is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokens(documents(spark, sf_dir))


_ENDINGS_SQL = " ".join(f"WHEN ends_with(lemma, '{e}') THEN {list(t)}" for e, t in tok.ENDINGS)
WORDS = r"""w0 AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS ws FROM documents),
w1 AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w0),
w AS (SELECT doc_id, i - 1 AS pos, ws[i] AS surface FROM w1)"""
TOKENS = rf"""t0 AS (SELECT doc_id, regexp_extract_all(text, '\p{{L}}+|[.?!]') AS ws FROM documents),
t1 AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t0),
t2 AS (SELECT doc_id, i - 1 AS pos, ws[i] AS surface, lower(ws[i]) AS lemma FROM t1),
t3 AS (SELECT *, CASE WHEN surface IN ('.', '?', '!') THEN ['sent'] {_ENDINGS_SQL} ELSE ['n'] END AS tags FROM t2),
t AS (SELECT *, array_to_string(tags, '|') AS class FROM t3)"""
CLASSES = """c0 AS (SELECT DISTINCT class FROM t UNION SELECT DISTINCT unnest(tags) FROM t
  UNION SELECT unnest(['adj', 'adv', 'n', 'sent', 'vblex', 'adj|adv|n|vblex'])),
c AS (SELECT class, string_split(class, '|') AS tags FROM c0)"""


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT surface) AS n_types, CAST(sum(pos) AS BIGINT) AS pos_sum FROM w GROUP BY doc_id")
def q_tokens(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("surface").alias("n_types"), F.sum("pos").alias("pos_sum"))


@query(f"WITH {WORDS} SELECT lower(surface) AS word, count(*) AS n FROM w GROUP BY 1")
def q_vocab(spark, sf_dir):
    return tok.vocabulary(tok.words(documents(spark, sf_dir)))


@query(f"WITH {WORDS} SELECT lower(surface) AS word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def q_topwords(spark, sf_dir):
    return tok.frequent_words(tok.words(documents(spark, sf_dir)), 50)


_SHARE = f"""WITH {WORDS}, v AS (SELECT lower(surface) AS word, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT n, sum(n) AS mass FROM v GROUP BY n),
k AS (SELECT n, sum(mass) OVER (ORDER BY n @dir) / sum(mass) OVER () AS share FROM g)
SELECT word, n FROM v WHERE n IN (SELECT n FROM k WHERE share <= @ratio)"""


@query(_SHARE.replace("@dir", "ASC").replace("@ratio", "0.3"))
def q_lowpass_words(spark, sf_dir):
    return tok.by_share(tok.vocabulary(tok.words(documents(spark, sf_dir))), 0.3, low=True).select("word", "n")


@query(_SHARE.replace("@dir", "DESC").replace("@ratio", "0.5"))
def q_highpass_words(spark, sf_dir):
    return tok.by_share(tok.vocabulary(tok.words(documents(spark, sf_dir))), 0.5, low=False).select("word", "n")


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(surface || ' {{') + 2) AS BIGINT) AS chars FROM w GROUP BY doc_id")
def q_readwords(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).withColumn("tags", F.array().cast("array<string>"))
    lines = tok.read_words(rows)
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line") + 1).alias("chars"))


@query(f"WITH {TOKENS}, s AS (SELECT *, coalesce(sum((class = 'sent')::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM t) SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, min(pos) AS first_pos, max(pos) AS last_pos FROM s GROUP BY doc_id, sent_id")
def q_sentence_ids(spark, sf_dir):
    return tok.sentences(toks(spark, sf_dir)).groupBy("doc_id", "sent_id").agg(F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


@query(f"WITH {TOKENS}, s AS (SELECT *, coalesce(sum((class = 'sent')::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM t), l AS (SELECT doc_id, sent_id, count(*) AS n FROM s GROUP BY 1, 2) SELECT n AS length, count(*) AS sentences FROM l GROUP BY 1")
def q_sentence_lengths(spark, sf_dir):
    rows = tok.sentences(toks(spark, sf_dir)).groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("length"))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("sentences"))


@query(f"WITH {WORDS}, g AS (SELECT surface, left(surface, 1) AS a, right(surface, 1) AS z FROM w) SELECT CASE WHEN NOT (a = upper(a) AND a <> lower(a)) THEN 'aa' WHEN length(surface) > 1 AND z = upper(z) AND z <> lower(z) THEN 'AA' ELSE 'Aa' END AS pattern, count(*) AS n, count(DISTINCT surface) AS types FROM g GROUP BY 1")
def q_caps_hist(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(case.getcase_col(F.col("surface")).alias("pattern")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))


@query(f"WITH {WORDS}, g AS (SELECT DISTINCT surface, left(surface, 1) AS a, right(surface, 1) AS z FROM w) SELECT surface, CASE WHEN NOT (a = upper(a) AND a <> lower(a)) THEN 'rule' WHEN length(surface) > 1 AND z = upper(z) AND z <> lower(z) THEN 'RULE' ELSE 'Rule' END AS target FROM g")
def q_copycase(spark, sf_dir):
    return tok.words(documents(spark, sf_dir)).select("surface").distinct().select("surface", case.copycase_col(F.col("surface"), F.lit("rULe")).alias("target"))


@query(f"WITH {WORDS} SELECT count(*) AS n, count(DISTINCT surface) AS types FROM w WHERE starts_with(lower(surface), 'th') OR starts_with(lower(surface), 'an')")
def q_prefix_list(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).where(rules.begins_with_list(F.col("surface"), ["th", "an"], caseless=True))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("surface").alias("types"))


@query(f"WITH {WORDS} SELECT count(*) AS n, count(DISTINCT surface) AS types FROM w WHERE ends_with(surface, 'ing') OR ends_with(surface, 'tion')")
def q_suffix_list(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).where(rules.ends_with_list(F.col("surface"), ["ing", "tion"]))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("surface").alias("types"))


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n FROM w WHERE lower(surface) IN ('the', 'and', 'der', 'la') GROUP BY 1")
def q_in_list(spark, sf_dir):
    return tok.words(documents(spark, sf_dir)).where(rules.in_list(F.col("surface"), ["the", "and", "der", "la"], caseless=True)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT count(*) AS n FROM w WHERE contains(lower(surface), 'ble')")
def q_contains(spark, sf_dir):
    return tok.words(documents(spark, sf_dir)).where(rules.contains_substring(F.col("surface"), F.lit("ble"), caseless=True)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS}, p AS (SELECT doc_id, surface, lead(surface) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM w) SELECT doc_id, count(*) AS n FROM p WHERE lower(surface) = lower(nxt) GROUP BY 1")
def q_equal_caseless(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tok.words(documents(spark, sf_dir)).withColumn("nxt", F.lead("surface").over(order))
    return rows.where(rules.equal(F.col("surface"), F.col("nxt"), caseless=True)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKENS} SELECT class, count(*) AS n, count(DISTINCT lemma) AS types FROM t GROUP BY class")
def q_category_counts(spark, sf_dir):
    rows = toks(spark, sf_dir).groupBy("class", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))


@query(f"WITH {TOKENS}, {CLASSES} SELECT class, CAST(len(tags) AS INTEGER) AS size FROM c")
def q_ambiguity_classes(spark, sf_dir):
    return tagger.ambiguity_classes(toks(spark, sf_dir)).select("class", F.size("tags").alias("size"))


@query(f"WITH {TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY doc_id, pos) AS k, count(*) OVER (PARTITION BY class) AS n FROM t) SELECT class, doc_id, pos, surface, n FROM r WHERE k = 1")
def q_first_example_per_class(spark, sf_dir):
    return tagger.first_examples(toks(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {TOKENS}, {CLASSES}, p AS (SELECT a.class, b.class AS similar_class, len(b.tags) AS k FROM (SELECT unnest(['adv|n', 'adj', 'n|vblex', 'adv|sent']) AS class) a JOIN c b ON list_has_all(b.tags, string_split(a.class, '|'))), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY k, similar_class) AS rn FROM p) SELECT x.class, similar_class FROM (SELECT unnest(['adv|n', 'adj', 'n|vblex', 'adv|sent']) AS class) x LEFT JOIN (SELECT * FROM r WHERE rn = 1) y USING (class)")
def q_similar_class(spark, sf_dir):
    wanted = spark.createDataFrame([(c, c.split("|")) for c in ("adv|n", "adj", "n|vblex", "adv|sent")], "class string, tags array<string>")
    return tagger.similar_classes(wanted, tagger.ambiguity_classes(toks(spark, sf_dir)))


_PAIRS = f"""{TOKENS}, {CLASSES},
o AS (SELECT lag(class, 1, 'sent') OVER (PARTITION BY doc_id ORDER BY pos) AS previous, class FROM t),
oc AS (SELECT previous, class, count(*) AS n FROM o GROUP BY 1, 2),
k AS (SELECT a.class AS previous, b.class, coalesce(n, 0) + 1 AS n, a.tags AS it, b.tags AS jt
      FROM c a CROSS JOIN c b LEFT JOIN oc ON oc.previous = a.class AND oc.class = b.class)"""


@query(f"WITH {_PAIRS}, e AS (SELECT i, unnest(jt) AS j, w FROM (SELECT unnest(it) AS i, jt, n / (len(it) * len(jt)) AS w FROM k)), s AS (SELECT i, j, sum(w) AS w FROM e GROUP BY 1, 2) SELECT i AS tag_i, j AS tag_j, round(w / sum(w) OVER (PARTITION BY i), 9) AS p FROM s")
def q_kupiec_transitions(spark, sf_dir):
    rows = toks(spark, sf_dir)
    return tagger.kupiec_transitions(rows, tagger.ambiguity_classes(rows)).withColumn("p", F.round("p", 9))


@query(f"WITH {_PAIRS}, s AS (SELECT previous AS class, any_value(it) AS tags, sum(n - 1) + 1 AS n FROM k GROUP BY 1), e AS (SELECT class, unnest(tags) AS tag, n / len(tags) AS w FROM s) SELECT tag, class, round(w / sum(w) OVER (PARTITION BY tag), 9) AS p FROM e")
def q_kupiec_emissions(spark, sf_dir):
    rows = toks(spark, sf_dir)
    return tagger.kupiec_emissions(rows, tagger.ambiguity_classes(rows)).withColumn("p", F.round("p", 9))


def gold(rows: DataFrame) -> DataFrame:
    """A reading of each token, chosen by its position, in place of a hand-tagged corpus."""
    return rows.withColumn("gold", F.element_at("tags", (F.col("pos") % F.size("tags") + 1).cast("int")))


_GOLD = f"{TOKENS}, {CLASSES}, g AS (SELECT *, tags[pos % len(tags) + 1] AS gold FROM t)"
_SUPERVISED = f"""WITH {_GOLD}, o AS (SELECT lag(gold, 1, 'sent') OVER (PARTITION BY doc_id ORDER BY pos) AS i, gold AS j FROM g),
n AS (SELECT i, j, count(*) AS n FROM o GROUP BY 1, 2), v AS (SELECT unnest(['adj', 'adv', 'n', 'sent', 'vblex']) AS v),
a AS (SELECT x.v AS tag_i, y.v AS tag_j, coalesce(n, 0) + 1 AS n FROM v x CROSS JOIN v y LEFT JOIN n ON n.i = x.v AND n.j = y.v),
p AS (SELECT tag_i, tag_j, n / sum(n) OVER (PARTITION BY tag_i) AS p FROM a)"""


@query(f"{_SUPERVISED} SELECT tag_i, tag_j, round(p, 9) AS p FROM p")
def q_supervised_transitions(spark, sf_dir):
    return tagger.supervised_transitions(gold(toks(spark, sf_dir)), list(tok.TAGS)).withColumn("p", F.round("p", 9))


@query(f"WITH {_GOLD}, n AS (SELECT gold AS tag, class, count(*) AS e FROM g GROUP BY 1, 2), x AS (SELECT class, unnest(tags) AS tag FROM c), y AS (SELECT tag, class, coalesce(e, 0) AS e FROM x LEFT JOIN n USING (tag, class)) SELECT tag, class, round((e + 1.0::DOUBLE / count(*) OVER (PARTITION BY tag)) / (sum(e) OVER (PARTITION BY tag) + 1), 9) AS p FROM y")
def q_supervised_emissions(spark, sf_dir):
    rows = gold(toks(spark, sf_dir))
    return tagger.supervised_emissions(rows, tagger.ambiguity_classes(rows)).withColumn("p", F.round("p", 9))


@query(f"{_SUPERVISED}, z AS (SELECT tag_i, tag_j, CASE WHEN (tag_i = 'adv' AND tag_j = 'sent') OR (tag_i = 'adj' AND tag_j NOT IN ('n', 'adj')) THEN 1e-10 ELSE p END AS p FROM p) SELECT tag_i, tag_j, round(p / sum(p) OVER (PARTITION BY tag_i), 9) AS p FROM z")
def q_apply_rules(spark, sf_dir):
    a = tagger.supervised_transitions(gold(toks(spark, sf_dir)), list(tok.TAGS))
    return tagger.apply_rules(a, [("adv", "sent")], {"adj": ["n", "adj"]}).withColumn("p", F.round("p", 9))


def _model(spark, sf_dir):
    rows = toks(spark, sf_dir)
    return rows, tagger.kupiec_model(rows)


#: Kupiec's model as two maps, distinct runs, and for each the best path to every tag of its next word.
_VITERBI = f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT i, unnest(jt) AS j, w FROM (SELECT unnest(it) AS i, jt, n / (len(it) * len(jt)) AS w FROM k)), es AS (SELECT i, j, sum(w) AS w FROM e GROUP BY 1, 2),
tr AS (SELECT i || ' ' || j AS key, w / sum(w) OVER (PARTITION BY i) AS p FROM es),
g AS (SELECT previous AS class, any_value(it) AS tags, sum(n - 1) + 1 AS n FROM k GROUP BY 1), h AS (SELECT class, unnest(tags) AS tag, n / len(tags) AS w FROM g),
em AS (SELECT tag || ' ' || class AS key, w / sum(w) OVER (PARTITION BY tag) AS p FROM h),
m AS (SELECT (SELECT map(list(key), list(p)) FROM tr) AS a, (SELECT map(list(key), list(p)) FROM em) AS b),
w AS (SELECT doc_id, pos, class, lag(class, 1, 'sent') OVER d AS before, coalesce(sum((len(tags) = 1)::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, run, first(before ORDER BY pos) AS start, list(class ORDER BY pos) AS classes FROM w GROUP BY 1, 2),
v AS (SELECT start, classes, 0 AS done, [{{'t': start, 'x': 1.0::DOUBLE, 'p': []::VARCHAR[]}}] AS best FROM (SELECT DISTINCT start, classes FROM r)
 UNION ALL SELECT start, classes, done + 1, list_transform(string_split(classes[done + 1], '|'), lambda i: list_reduce(list_prepend({{'t': i, 'x': 0.0::DOUBLE, 'p': [i]}},
  list_transform(best, lambda s: {{'t': i, 'x': s.x * a[s.t || ' ' || i] * b[i || ' ' || classes[done + 1]], 'p': list_append(s.p, i)}})), lambda u, y: CASE WHEN u.x <= y.x THEN y ELSE u END)) FROM v, m WHERE done < len(classes)),
z AS (SELECT start, classes, list_reduce(best, lambda u, y: CASE WHEN u.x <= y.x THEN y ELSE u END).p AS path FROM v WHERE done = len(classes))
SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(path) AS tag FROM r JOIN z USING (start, classes)) GROUP BY 1, 2"""


@query(_VITERBI)
def q_viterbi(spark, sf_dir):
    rows, model = _model(spark, sf_dir)
    return tagger.viterbi(rows, model).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_baum_welch_step(spark, sf_dir):
    rows, model = _model(spark, sf_dir)
    after, _ = tagger.baum_welch_step(rows, model)
    return spark.createDataFrame([(i, j, round(p, 9)) for (i, j), p in sorted(after["a"].items())], "tag_i string, tag_j string, p double")


_TRIPLES = f"""{TOKENS}, x AS (SELECT coalesce(lag(tags) OVER o, ['sent']) AS lt, tags AS mt, lead(tags) OVER o AS rt FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
wn AS (SELECT lt, mt, rt, count(*) AS windows FROM x WHERE rt IS NOT NULL GROUP BY 1, 2, 3),
e1 AS (SELECT *, unnest(lt) AS l FROM wn), e2 AS (SELECT *, unnest(mt) AS m FROM e1), e AS (SELECT *, unnest(rt) AS r FROM e2),
i0 AS (SELECT * FROM e WHERE NOT ((l = 'adv' AND m = 'sent') OR (m = 'adv' AND r = 'sent'))),
i1 AS (SELECT l, m, r, windows / count(*) OVER (PARTITION BY lt, mt, rt) AS d FROM i0),
ini AS (SELECT l, m, r, sum(d) AS d FROM i1 GROUP BY 1, 2, 3),
s0 AS (SELECT e.*, coalesce(d, 0) AS d, sum(coalesce(d, 0)) OVER (PARTITION BY lt, mt, rt) AS total FROM e LEFT JOIN ini USING (l, m, r)),
stp AS (SELECT l, m, r, sum(windows * d / total) AS d FROM s0 WHERE total > 1e-10 GROUP BY 1, 2, 3)"""
_FORBID = [("adv", "sent")]


@query(f"WITH {_TRIPLES} SELECT l, m, r, round(d, 6) AS d FROM ini")
def q_lsw_init(spark, sf_dir):
    return tagger.lsw_initial(toks(spark, sf_dir), _FORBID).withColumn("d", F.round("d", 6))


@query(f"WITH {_TRIPLES} SELECT l, m, r, round(d, 6) AS d FROM stp WHERE d > 0")
def q_lsw_step(spark, sf_dir):
    rows = toks(spark, sf_dir)
    return tagger.lsw_step(rows, tagger.lsw_initial(rows, _FORBID)).withColumn("d", F.round("d", 6))


@query(f"WITH {_TRIPLES}, q AS (SELECT lt, mt, rt, windows, m, round(sum(coalesce(d, 0)), 9) AS s FROM e LEFT JOIN ini USING (l, m, r) GROUP BY 1, 2, 3, 4, 5), b AS (SELECT *, row_number() OVER (PARTITION BY lt, mt, rt ORDER BY s DESC, m) AS k FROM q) SELECT array_to_string(mt, '|') AS class, m AS tag, CAST(sum(windows) AS BIGINT) AS n FROM b WHERE k = 1 GROUP BY 1, 2")
def q_lsw_decode(spark, sf_dir):
    rows = toks(spark, sf_dir)
    best = tagger.lsw_choices(rows, tagger.lsw_initial(rows, _FORBID))
    return best.groupBy(F.array_join("mid", "|").alias("class"), "tag").agg(F.sum("windows").alias("n"))


_COUNTS = f"""{TOKENS}, nn AS (SELECT CAST(round(exp(sum(ln(k)))) AS BIGINT) AS c FROM (SELECT DISTINCT len(tags) AS k FROM t)),
u0 AS (SELECT lemma, len(tags) AS k, unnest(tags) AS tag FROM t),
u AS (SELECT lemma, tag, CAST(sum((SELECT c FROM nn) // k) AS BIGINT) AS f FROM u0 GROUP BY 1, 2)"""


def _counts(spark, sf_dir):
    rows = toks(spark, sf_dir)
    return rows, tagger.unigram_counts(rows, tagger.corpus_coefficient(rows))


@query(f"WITH {_COUNTS} SELECT lemma, tag, f FROM u")
def q_unigram1_counts(spark, sf_dir):
    return _counts(spark, sf_dir)[1]


@query(f"WITH {_COUNTS}, f AS (SELECT DISTINCT lemma, class, tags FROM t), x AS (SELECT lemma, class, tags, unnest(range(1, len(tags) + 1)) AS k FROM f), y AS (SELECT x.lemma, class, tags[k] AS tag, k, coalesce(u.f, 0) + 1 AS s FROM x LEFT JOIN u ON u.lemma = x.lemma AND u.tag = x.tags[x.k]), b AS (SELECT *, row_number() OVER (PARTITION BY lemma, class ORDER BY s DESC, k) AS rn FROM y) SELECT class, tag, count(*) AS types FROM b WHERE rn = 1 GROUP BY 1, 2")
def q_unigram1_decode(spark, sf_dir):
    rows, counts = _counts(spark, sf_dir)
    return tagger.unigram_decode(rows, tagger.unigram_scores(counts, 1)).groupBy("class", "tag").agg(F.count(F.lit(1)).alias("types"))


@query(f"WITH {_COUNTS}, g AS (SELECT tag, sum(f) AS sf, count(*) AS ty FROM u GROUP BY 1) SELECT lemma, u.tag, f, round((1 + f)::DOUBLE * (1 + sf)::DOUBLE / ((1 + sf) + ty)::DOUBLE, 6) AS score FROM u JOIN g ON u.tag = g.tag")
def q_unigram2_score(spark, sf_dir):
    return tagger.unigram_scores(_counts(spark, sf_dir)[1], 2).withColumn("score", F.round("score", 6))


@query(f"WITH {_COUNTS} SELECT tag, CAST(sum(f) AS BIGINT) AS sum_f, count(*) AS lemmas, max(f) AS max_f FROM u GROUP BY tag")
def q_unigram3_counts(spark, sf_dir):
    return _counts(spark, sf_dir)[1].groupBy("tag").agg(F.sum("f").alias("sum_f"), F.count(F.lit(1)).alias("lemmas"), F.max("f").alias("max_f"))


@query(f"WITH {TOKENS}, f AS (SELECT len(tags) AS k, row_number() OVER (ORDER BY min(doc_id * 10000000 + pos)) AS i FROM t GROUP BY 1), l AS (SELECT list(k ORDER BY i) AS ks FROM f) SELECT CAST(list_reduce(list_prepend(1, ks), lambda c, k: CASE WHEN c % k = 0 THEN c ELSE c * k END) AS BIGINT) AS coefficient FROM l")
def q_coefficient(spark, sf_dir):
    return spark.createDataFrame([(tagger.corpus_coefficient(toks(spark, sf_dir)),)], "coefficient long")
