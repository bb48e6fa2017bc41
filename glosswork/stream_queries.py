"""Driver queries over streams, documents and sentence pairs."""

from __future__ import annotations

import tempfile
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.case import getcase_col
from .operators import align, caps, dictionary, lookups, multiple, perceptron, streamops, tokens as tok, transfer
from .plans.pipeline import Pipeline, Registry, Step, with_word_blanks
from .queries import QUERIES, TOKENS, WORDS, documents, query, spread, table, toks
from .sources import corpora, formats
from .streaming import segments

#: Small rule files for the queries: one of each level, and capitals.
TRANSFER = """<transfer default="chunk">
 <section-def-cats><def-cat n="noun"><cat-item tags="n"/></def-cat><def-cat n="adj"><cat-item tags="adj"/></def-cat><def-cat n="verb"><cat-item tags="vblex"/></def-cat></section-def-cats>
 <section-def-attrs><def-attr n="pos"><attr-item tags="n"/><attr-item tags="adj"/><attr-item tags="vblex"/></def-attr></section-def-attrs>
 <section-def-vars><def-var n="case"/></section-def-vars>
 <section-rules>
  <rule><pattern><pattern-item n="adj"/><pattern-item n="noun"/></pattern><action>
   <let><var n="case"/><case-of pos="1" side="tl" part="lem"/></let>
   <out><chunk name="an" case="case"><tags><tag><lit-tag v="SN.sg"/></tag></tags>
    <lu><clip pos="2" side="tl" part="lem"/><clip pos="2" side="tl" part="pos"/><clip pos="2" side="tl" part="pos" link-to="2"/></lu><b/>
    <lu><clip pos="1" side="tl" part="whole"/></lu></chunk></out></action></rule>
  <rule><pattern><pattern-item n="noun"/></pattern><action>
   <out><chunk name="n"><tags><tag><lit-tag v="SN"/></tag></tags><lu><clip pos="1" side="tl" part="whole"/></lu></chunk></out></action></rule>
 </section-rules></transfer>"""
INTERCHUNK = """<interchunk>
 <section-def-cats><def-cat n="SN"><cat-item tags="SN"/><cat-item tags="SN.*"/></def-cat><def-cat n="other"><cat-item tags="default"/></def-cat></section-def-cats>
 <section-rules><rule><pattern><pattern-item n="other"/><pattern-item n="SN"/></pattern><action>
  <out><chunk><clip pos="2" part="lem"/><clip pos="2" part="tags"/><clip pos="2" part="chcontent"/></chunk><b/>
  <chunk><clip pos="1" part="lem"/><clip pos="1" part="tags"/><clip pos="1" part="chcontent"/></chunk></out></action></rule></section-rules></interchunk>"""
POSTCHUNK = """<postchunk><section-def-cats><def-cat n="an"><cat-item name="an"/></def-cat></section-def-cats>
 <section-rules><rule><pattern><pattern-item n="an"/></pattern><action>
  <out><lu><clip pos="1" part="whole"/></lu><b/><lu><clip pos="2" part="whole"/></lu></out></action></rule></section-rules></postchunk>"""
#: Nouns keep the case that their source had, less so other words; a noun that opens a segment is a title.
CAPITALS = """<capitalization><rules>
 <rule weight="3"><match select="aa" tags="vblex"/></rule>
 <rule weight="2"><match srcsurf="Aa" select="Aa" tags="n"/></rule>
 <rule weight="2.5"><match srcsurf="AA" select="AA" tags="n"/></rule>
 <rule weight="4"><begin/><match select="Aa" tags="n"/></rule></rules></capitalization>"""


def pair(surface: F.Column) -> F.Column:
    """A word's unit source/target, both its lemma with its first reading."""
    unit = F.concat(F.lower(surface), F.lit("<"), F.element_at(tok.readings_col(surface), 1), F.lit(">"))
    return F.concat(F.lit("^"), unit, F.lit("/"), unit, F.lit("$"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, stream) of units ^source/target$ with each token's first reading."""
    return tok.text_streams(documents(spark, sf_dir), pair)


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.text_streams(documents(spark, sf_dir))


def digest(df: DataFrame, column: str = "stream", *keys: str) -> DataFrame:
    return df.select(*(keys or ("doc_id",)), F.md5(F.col(column).cast("binary")).alias("digest"), F.length(column).alias("chars"))


@query("SELECT doc_id, md5(regexp_replace(text, ' +', ' ', 'g')) AS digest, CAST(length(regexp_replace(text, ' +', ' ', 'g')) AS INTEGER) AS chars FROM documents")
def q_squeeze_spaces(spark, sf_dir):
    return digest(documents(spark, sf_dir).withColumn("stream", streamops.posttransfer_col(F.col("text"))))


_LU = f"WITH {TOKENS}, u AS (SELECT doc_id, pos, '^' || surface || array_to_string(list_transform(tags, lambda x: '/' || lemma || '<' || x || '>'), '') || '$' AS lu FROM t)"


@query(f"{_LU}, s AS (SELECT doc_id, ' ' || string_agg(lu, ' ' ORDER BY pos) AS stream FROM u GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_clean_stream(spark, sf_dir):
    rows = analysed(spark, sf_dir).withColumn("stream", F.concat(F.lit("[<div>]"), F.replace(F.col("stream"), F.lit("$ ^"), F.lit("$ , ^"))))
    return digest(streamops.apply(rows, streamops.cleanstream))


@query(f"WITH {WORDS}, s AS (SELECT doc_id, string_agg('^' || surface || '# q<n>$ ^' || surface || '<po>$', ' ' ORDER BY pos) AS stream FROM w GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_pretransfer_split(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).withColumn("lu", F.concat(F.lit("^"), "surface", F.lit("<n>+"), "surface", F.lit("<po># q$")))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lu"))).alias("u")).select("doc_id", F.array_join(F.transform("u", lambda x: x["lu"]), " ").alias("stream"))
    return digest(streamops.apply(rows, streamops.pretransfer))


@query(f"WITH {WORDS}, g AS (SELECT DISTINCT surface, left(surface, 1) AS a, right(surface, 1) AS z FROM w) SELECT surface, CASE WHEN NOT (a = upper(a) AND a <> lower(a)) THEN 'aa' WHEN length(surface) > 1 AND z = upper(z) AND z <> lower(z) THEN 'AA' ELSE 'Aa' END AS pattern FROM g")
def q_getcase(spark, sf_dir):
    return tok.words(documents(spark, sf_dir)).select("surface").distinct().select("surface", getcase_col(F.col("surface")).alias("pattern"))


@query(f"{_LU}, c AS (SELECT doc_id, u.pos, '[[c:' || CASE WHEN NOT (left(surface, 1) = upper(left(surface, 1)) AND left(surface, 1) <> lower(left(surface, 1))) THEN 'aa' WHEN length(surface) > 1 AND right(surface, 1) = upper(right(surface, 1)) AND right(surface, 1) <> lower(right(surface, 1)) THEN 'AA' ELSE 'Aa' END || '/aa]]^' || lemma || '<' || tags[1] || '>$' AS lu FROM u JOIN t USING (doc_id, pos)), s AS (SELECT doc_id, string_agg(lu, ' ' ORDER BY pos) AS stream FROM c GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_extract_caps(spark, sf_dir):
    return digest(streamops.apply(analysed(spark, sf_dir), streamops.extract_caps))


_CASES = "w AS (SELECT doc_id, pos, tags[1] AS tag, CASE WHEN NOT (left(surface, 1) = upper(left(surface, 1)) AND left(surface, 1) <> lower(left(surface, 1))) THEN 'aa' WHEN length(surface) > 1 AND right(surface, 1) = upper(right(surface, 1)) AND right(surface, 1) <> lower(right(surface, 1)) THEN 'AA' ELSE 'Aa' END AS shape, lemma, replace(upper(lemma), 'ẞ', 'ß') AS up FROM t)"


@query(f"WITH {TOKENS}, {_CASES}, v AS (SELECT doc_id, pos, CASE WHEN tag = 'n' AND (pos = 0 OR shape = 'Aa') AND NOT (shape = 'AA' AND pos > 0) THEN left(up, 1) || substr(lemma, 2) WHEN tag = 'n' AND shape = 'AA' THEN up ELSE lemma END AS word FROM w), s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS stream FROM v GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_restore_caps(spark, sf_dir):
    rows = streamops.apply(analysed(spark, sf_dir), partial(streamops.extract_caps, keep_surface=False))
    lower = F.regexp_replace("stream", r"\^([^<$]*)((?:<[^>]*>)+)\$", r"^$1$2/$1\$")
    return digest(caps.restore(rows.withColumn("stream", lower), caps.CapsRules(CAPITALS)))


@query(f"{_LU}, s AS (SELECT doc_id, string_agg('[[t:i:1]]' || lu || '[[/]]', ' ' ORDER BY pos) AS stream FROM u GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_wblank_spread(spark, sf_dir):
    rows = analysed(spark, sf_dir).withColumn("stream", F.concat(F.lit("[[t:i:1]]"), "stream", F.lit("[[/]]")))
    return digest(streamops.apply(rows, streamops.fused(streamops.attach_wblanks, streamops.detach_wblanks)))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n, CAST(sum(length(lemma) + length(tag)) AS BIGINT) AS chars FROM (SELECT doc_id, lemma, unnest(tags) AS tag FROM t) GROUP BY doc_id")
def q_token_table(spark, sf_dir):
    rows = streamops.tokens_of(analysed(spark, sf_dir)).where("raw is not null").select("doc_id", F.explode("readings").alias("r"))
    rows = rows.select("doc_id", F.col("r.morphemes")[0].alias("m"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.lemma") + F.length(F.col("m.tags")[0])).alias("chars"))


#: What the rules of TRANSFER make of each place: an adjective and a noun together, a noun, another word.
_PIECES = f"""WITH {TOKENS}, n AS (SELECT doc_id, pos, lemma, tags[1] AS tag, lead(lemma) OVER o AS lemma2, lead(tags[1]) OVER o AS tag2, lag(tags[1]) OVER o AS tag0 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN tag = 'adj' AND tag2 = 'n' THEN 'an' WHEN tag <> 'n' THEN 'default' WHEN tag0 = 'adj' THEN NULL ELSE 'n' END AS kind FROM n),
p AS (SELECT doc_id, pos, kind, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
 CASE kind WHEN 'an' THEN '^an<SN><sg>{{^' || lemma2 || '<n><2>$ ^' || lemma || '<adj>$}}$' WHEN 'n' THEN '^n<SN>{{^' || lemma || '<n>$}}$' ELSE '^default<default>{{^' || lemma || '<' || tag || '>$}}$' END AS piece,
 CASE kind WHEN 'an' THEN '^' || lemma2 || '<n><sg>$ ^' || lemma || '<adj>$' ELSE '^' || lemma || '<' || tag || '>$' END AS words FROM k WHERE kind IS NOT NULL)"""


@query(f"{_PIECES}, s AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS stream FROM p GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_transfer(spark, sf_dir):
    return digest(streamops.apply(joined(spark, sf_dir), partial(transfer.transfer, transfer.RuleSet(TRANSFER))))


@query(f"{_PIECES}, o AS (SELECT doc_id, words, CASE WHEN kind = 'default' AND lead(kind) OVER d <> 'default' THEN i + 1 WHEN kind <> 'default' AND lag(kind) OVER d = 'default' THEN i - 1 ELSE i END AS place FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)), s AS (SELECT doc_id, string_agg(words, ' ' ORDER BY place) AS stream FROM o GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_transfer_levels(spark, sf_dir):
    """All three levels and what stands around them, from a declared pipeline, in one pass."""
    registry = Registry()
    registry.register("transfer", lambda files, flags: partial(transfer.transfer, transfer.RuleSet(TRANSFER)))
    registry.register("interchunk", lambda files, flags: partial(transfer.interchunk, transfer.RuleSet(INTERCHUNK)))
    registry.register("postchunk", lambda files, flags: partial(transfer.postchunk, transfer.RuleSet(POSTCHUNK)))
    steps = (Step("transfer", (), ("-b",)), Step("interchunk"), Step("postchunk"))
    return digest(registry.run(joined(spark, sf_dir), with_word_blanks(Pipeline("demo", steps))))


@query(f"{_PIECES} SELECT kind AS chunk, count(*) AS n FROM p GROUP BY 1")
def q_lrlm_chunks(spark, sf_dir):
    rows = streamops.apply(joined(spark, sf_dir), partial(transfer.transfer, transfer.RuleSet(TRANSFER)))
    found = rows.select(F.explode(F.regexp_extract_all("stream", F.lit(r"\^([^<>{}^$]+)(?:<[^<>]*>)*\{"), F.lit(1))).alias("chunk"))
    return found.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS}, s AS (SELECT doc_id, string_agg('^' || lower(surface) || '<n><sg>$', ' ' ORDER BY pos) AS stream FROM w GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_unchunk(spark, sf_dir):
    rows = tok.words(documents(spark, sf_dir)).withColumn("lu", F.concat(F.lit("^np<SN><sg>{^"), F.lower("surface"), F.lit("<n><2>$}$")))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lu"))).alias("u")).select("doc_id", F.array_join(F.transform("u", lambda x: x["lu"]), " ").alias("stream"))
    return digest(streamops.apply(rows, partial(transfer.postchunk, transfer.RuleSet("<postchunk/>"))))


#: Each word with itself and with ``x`` before it: two alternatives for a word, four for a pair, in the order of the words.
_ALTERNATIVES = f"""{_PIECES}, x AS (SELECT doc_id, pos, kind, '^' || lemma || '<' || tag || '>$' AS a, '^x' || lemma || '<' || tag || '>$' AS b, '^' || lemma2 || '<' || tag2 || '>$' AS c, '^x' || lemma2 || '<' || tag2 || '>$' AS d FROM k WHERE kind IS NOT NULL),
y AS (SELECT doc_id, pos, CASE kind WHEN 'an' THEN '[{{]' || a || ' ' || c || '[|]' || a || ' ' || d || '[|]' || b || ' ' || c || '[|]' || b || ' ' || d || '.[][}}]' WHEN 'n' THEN '[{{]' || a || '[|]' || b || '.[][}}]' ELSE a END AS piece FROM x)"""


@query(f"{_ALTERNATIVES}, s AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS stream FROM y GROUP BY doc_id) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_multiple_windows(spark, sf_dir):
    rows = joined(spark, sf_dir).withColumn("stream", F.regexp_replace("stream", r"\^([^/$]*)/([^$]*)\$", r"^$1/$2/x$2\$"))
    return digest(streamops.apply(rows, partial(multiple.expand, rules=transfer.RuleSet(TRANSFER))))


@query(f"WITH {TOKENS} SELECT doc_id, tag AS translation, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM t) GROUP BY 1, 2")
def q_multi_translations(spark, sf_dir):
    return multiple.expand_rows(toks(spark, sf_dir), "tags").groupBy("doc_id", "translation").agg(F.count(F.lit(1)).alias("n"))


_DICTIONARY = f"WITH {WORDS}, v AS (SELECT lower(surface) AS word, count(*) AS n FROM w GROUP BY 1)"


def _dictionaries(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    words = tok.words(documents(spark, sf_dir)).withColumn("lemma", F.lower("surface"))
    vocabulary = tok.vocabulary(words)
    entries = vocabulary.select(F.col("word").alias("source"), F.concat(F.lit("t_"), "word").alias("target"), "n")
    return words, entries.where("n >= 10").drop("n"), entries.where("n between 5 and 9").drop("n")


@query(f"{_DICTIONARY} SELECT CASE WHEN n >= 10 THEN 'found' WHEN n >= 5 THEN 'extended' ELSE 'untranslated' END AS status, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (length(word) + CASE WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 3 ELSE 1 END)) AS BIGINT) AS chars FROM v GROUP BY 1")
def q_bilingual_lookup(spark, sf_dir):
    words, first, extended = _dictionaries(spark, sf_dir)
    return lookups.bilingual(words, first, extended).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("target")).alias("chars"))


@query(f"{_DICTIONARY} SELECT word, n FROM v WHERE n < 10")
def q_unknown_words(spark, sf_dir):
    words, first, _ = _dictionaries(spark, sf_dir)
    return lookups.unknown_words(words, first)


# formats


def _pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


@query()
def q_deformat_html(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("stream", streamops.on("html", partial(formats.deformat, fmt=formats.FORMATS["html"])))
    return rows.select("page_id", F.length("stream").alias("chars"), F.regexp_count("stream", F.lit(r"\.\[\]")).alias("stops"), F.md5(F.col("stream").cast("binary")).alias("digest"))


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS chars, md5(html) AS digest FROM pages")
def q_reformat_roundtrip(spark, sf_dir):
    fmt = formats.FORMATS["html-noent"]
    back = streamops.on("html", streamops.fused(partial(formats.deformat, fmt=fmt), partial(formats.reformat, fmt=fmt)))
    return _pages(spark, sf_dir).withColumn("back", back).select("page_id", F.length("back").alias("chars"), F.md5(F.col("back").cast("binary")).alias("digest"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '</(title|h[1-6])>')) AS INTEGER) AS marks FROM pages")
def q_heading_marks(spark, sf_dir):
    rows = _pages(spark, sf_dir).withColumn("stream", streamops.on("html", partial(formats.deformat, fmt=formats.FORMATS["html-noent"], headings=True)))
    return rows.select("page_id", F.regexp_count("stream", F.lit(r"\[\]" + formats.HEADING)).alias("marks"))


#: LaTeX's special characters as commands (fixed values); the backslash goes first.
LATEX = (("\\", "\\textbackslash "), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("%", "\\%"), ("&", "\\&"), ("#", "\\#"), ("_", "\\_"), ("^", "\\textasciicircum "), ("~", "\\textasciitilde "))


def _latex_sql() -> str:
    text = "text"
    for a, b in LATEX:
        text = f"replace({text}, '{a}', '{b}')"
    head, tail = r"\section{Title} \emph{", r"\begin{itemize}\item[a] b\end{itemize}"
    return f"'{head}' || {text} || '}} $x_1^2$ % end' || chr(10) || '{tail}'"


@query(f"WITH s AS (SELECT doc_id, {_latex_sql()} AS stream FROM documents) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s")
def q_latex_roundtrip(spark, sf_dir):
    """Every text, its special characters as commands, among commands, groups, mathematics, a comment and an environment."""
    text = F.col("text")
    for a, b in LATEX:
        text = F.replace(text, F.lit(a), F.lit(b))
    tex = F.concat(F.lit("\\section{Title} \\emph{"), text, F.lit("} $x_1^2$ % end\n\\begin{itemize}\\item[a] b\\end{itemize}"))
    rows = documents(spark, sf_dir).withColumn("tex", tex)
    return digest(rows.withColumn("stream", streamops.on("tex", streamops.fused(formats.deformat_latex, formats.reformat_latex))))


# sentence pairs

_TURNS = """p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
q AS (SELECT conv_id, turn, a, b, regexp_extract_all(lower(a), '\\p{L}+') AS aw, regexp_extract_all(lower(b), '\\p{L}+') AS bw FROM p WHERE nxt IS NOT NULL)"""


def turn_pairs(spark, sf_dir, word: str = r"(\p{L}+)") -> DataFrame:
    """(conv_id, turn, a, b, aw, bw): each turn with the next one, and their words."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(order).alias("b"), F.lead("turn").over(order).alias("next")).where("next is not null")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(word), F.lit(1))
    return rows.select("conv_id", "turn", "a", "b", words("a").alias("aw"), words("b").alias("bw"))


@query(f"WITH {_TURNS}, e AS (SELECT s, unnest(bw) AS t, n FROM (SELECT unnest(aw) AS s, bw, len(aw) AS n FROM q)), c AS (SELECT s, t, sum(1.0::DOUBLE / n) AS c FROM e GROUP BY 1, 2) SELECT s, t, round(c / sum(c) OVER (PARTITION BY s), 8) AS p FROM c")
def q_ibm1_first_estimate(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select(F.col("aw").alias("source"), F.col("bw").alias("target"))
    return align.model_one(pairs).withColumn("p", F.round("p", 8))


_NUMBERED = _TURNS.replace("\\\\p{L}+", "\\\\p{L}+|[0-9]+") if False else _TURNS.replace("p{L}+", "p{L}+|[0-9]+")


@query(f"""WITH {_NUMBERED}, l AS (SELECT conv_id, turn, list_max(aw) AS am, list_max(bw) AS bm FROM q),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(aw) AS w FROM q) GROUP BY ALL),
y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(bw) AS w FROM q) GROUP BY ALL),
z AS (SELECT conv_id, turn, w, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b, regexp_full_match(w, '[0-9]+') AS number FROM x FULL JOIN y USING (conv_id, turn, w)),
o AS (SELECT conv_id, turn, sum(least(a, b)) AS n, sum(CASE WHEN number THEN least(a, b) ELSE 0 END) AS same,
 sum(CASE WHEN number AND a > b AND w < bm THEN a - b WHEN number AND b > a AND w < am THEN b - a ELSE 0 END) AS differing FROM z JOIN l USING (conv_id, turn) GROUP BY 1, 2)
SELECT conv_id, turn, CAST(coalesce(n, 0) + CASE WHEN same > 0 AND differing <= same // 5 THEN 10 ELSE 0 END AS INTEGER) AS common FROM q LEFT JOIN o USING (conv_id, turn)""")
def q_word_overlap(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir, r"(\p{L}+|[0-9]+)")
    return rows.select("conv_id", "turn", align.overlap_col(F.col("aw"), F.col("bw")).cast("int").alias("common"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, round(0.3 - 0.3 * ((greatest(length(a), length(b)) + 1)::DOUBLE / (least(length(a), length(b)) + 1) - 1), 9) AS close FROM q")
def q_closeness(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(align.closeness_col(F.length("a"), F.length("b")), 9).alias("close"))


@query()
def q_aligned_pairs(spark, sf_dir):
    sides = lambda c: F.filter(F.split(c, r"(?<=[.?!])\s+"), lambda s: s != "")
    pairs = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), sides("a").alias("source"), sides("b").alias("target"))
    return align.align_documents(pairs).select("pair_id", F.size("rungs").alias("rungs"), F.round(F.element_at("scores", -1), 9).alias("score")).where("rungs > 0")


@query()
def q_edit_similar(spark, sf_dir):
    @F.arrow_udf("boolean")
    def alike(a, b):
        import pyarrow as pa

        return pa.array([align.similar(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return turn_pairs(spark, sf_dir).select("conv_id", "turn", alike("a", "b").alias("alike"))


def _unit_sql(column: str) -> str:
    text = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = f"replace({text}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({text}, '\\.+$', ''), '\\s+$', '')"


def _is_unit_sql(column: str) -> str:
    return f"len(regexp_extract_all(regexp_extract({column}, '(?s)(\\p{{L}}.*)', 1), ' ')) > 2"


@query(f"""WITH {_TURNS} SELECT conv_id, turn, md5('<tu><tuv xml:lang="a"><seg>' || {_unit_sql("a")} || '</seg></tuv><tuv xml:lang="b"><seg>' || {_unit_sql("b")} || '</seg></tuv></tu>') AS digest FROM q WHERE {_is_unit_sql("a")} AND {_is_unit_sql("b")}""")
def q_tmx_units(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select(F.col("a").alias("source"), F.col("b").alias("target"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.md5(corpora.unit_column().cast("binary")).alias("digest")).where("digest is not null")


@query()
def q_memory_units(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("a").alias("source"), F.col("b").alias("target"))
    return corpora.build_memory(rows).select("pair_id", "step", F.md5(F.col("unit").cast("binary")).alias("digest"))


@query(f"WITH {_TURNS}, a AS (SELECT DISTINCT conv_id, turn % 3 AS s FROM q WHERE length(a) > 100), b AS (SELECT DISTINCT conv_id, turn % 3 AS s FROM q WHERE length(b) > 100) SELECT round((SELECT count(*) FROM a JOIN b USING (conv_id, s)) / (SELECT count(*) FROM a), 9) AS precision, round((SELECT count(*) FROM a JOIN b USING (conv_id, s)) / (SELECT count(*) FROM b), 9) AS recall")
def q_precision_recall(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).withColumn("source", F.col("turn") % 3).withColumn("target", F.lit(0)).withColumn("pair_id", F.col("conv_id"))
    keys = ["pair_id", "source", "target"]
    found, truth = rows.where(F.length("a") > 100).select(*keys).distinct(), rows.where(F.length("b") > 100).select(*keys).distinct()
    return align.precision_recall(found, truth).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# dictionaries


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src0'")
def q_variant_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("v", F.array("lang", "source"))
    return dictionary.keep_all_requested(rows, ["de", "src0"]).drop("v")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' OR source = 'src0'")
def q_variant_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("v", F.array("lang", "source"))
    return dictionary.keep_any_requested(rows, ["de", "src0"]).drop("v")


@query("WITH e AS (SELECT lang || source AS k, doc_id, n_chars % 7 = 0 AS d FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC, doc_id) AS rn FROM e) SELECT k, doc_id FROM r WHERE rn = 1")
def q_default_translations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat("lang", "source").alias("source"), F.col("doc_id").alias("target"), F.col("doc_id").alias("position"), (F.col("n_chars") % 7 == 0).alias("is_default"))
    return dictionary.default_translations(rows).where("chosen").select(F.col("source").alias("k"), F.col("target").alias("doc_id"))


# perceptron, streaming


#: Sentences that the perceptron of the query is trained on, a documented bound.
SENTENCES = 1000


@query()
def q_perceptron_tag(spark, sf_dir):
    """Trained on SENTENCES sentences, in the order of a hash of their place, applied to all."""
    rows = tok.sentences(toks(spark, sf_dir))
    lemma = lambda t: F.concat(F.lit("/"), F.col("lemma"), F.lit("<"), t, F.lit(">"))
    rows = rows.withColumn("lu", F.concat(F.lit("^"), "surface", F.array_join(F.transform("tags", lemma), ""), F.lit("$")))
    gold = F.element_at("tags", (F.length("surface") % F.size("tags") + 1).cast("int"))
    rows = rows.withColumn("gold", F.concat(F.lit("^"), "surface", F.lit("/"), "lemma", F.lit("<"), gold, F.lit(">$")))
    rows = rows.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lu", "gold"))).alias("u"))
    line = lambda f: F.array_join(F.transform("u", lambda x: x[f]), " ")
    rows = rows.select("doc_id", "sent_id", line("lu").alias("stream"), line("gold").alias("gold"))
    sample = rows.orderBy(F.xxhash64("doc_id", "sent_id"), "doc_id", "sent_id").limit(SENTENCES).collect()
    templates = perceptron.Templates(perceptron.DEFAULT)
    model = perceptron.train([(perceptron.sentence_of(r["stream"]), perceptron.gold_of(r["gold"])) for r in sample], templates, 2)
    tagged = streamops.apply(rows, partial(perceptron.tag_text, model=model))
    return tagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.regexp_count("stream", F.lit("<vblex>"))).alias("verbs"))


@query("SELECT doc_id, md5(regexp_replace(text, ' +', ' ', 'g')) AS digest FROM documents")
def q_stream_equals_batch(spark, sf_dir):
    """Every document through a segment function in a streaming run; the SQL is that of the batch."""
    held = table(spark, sf_dir, "documents")
    schema = ", ".join(f"{n} {t}" for n, t in held.dtypes)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"{named}/q-stream-{spark.sparkContext.startTime}-{id(held)}" if named else tempfile.mkdtemp()
    stream = segments.process(segments.read(spark, f"{sf_dir}/documents.parquet*", schema), streamops.posttransfer, "text")
    segments.write(stream.select("doc_id", "text"), f"{root}/out", f"{root}/state").awaitTermination()
    out = spark.read.schema("doc_id long, text string").parquet(f"{root}/out")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


__all__ = ["QUERIES"]
