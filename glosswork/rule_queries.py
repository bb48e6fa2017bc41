"""Driver queries over the rule language, tag specifications, corpora and dictionaries, each with its SQL.

Rules of these queries look at one word or at two, so that SQL can say what they make of each place.
"""

from __future__ import annotations

import re
import unicodedata
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.case import copycase_col
from .functions.stream import parse
from .operators import align, dictionary, lookups, streamops, tokens as tok, transfer
from .operators.tagspec import TagSpec
from .queries import TOKENS, WORDS, documents, gold, query, table, toks
from .sources import formats
from .stream_queries import _CASES, _TURNS, digest, turn_pairs

_STREAM = "SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars FROM s"


def _joined(piece: str, source: str) -> str:
    return f"s AS (SELECT doc_id, string_agg({piece}, ' ' ORDER BY pos) AS stream FROM {source} GROUP BY doc_id) {_STREAM}"


def cased(surface: F.Column) -> F.Column:
    """A word's unit source/target, both as written, with its first reading."""
    unit = F.concat(surface, F.lit("<"), F.element_at(tok.readings_col(surface), 1), F.lit(">"))
    return F.concat(F.lit("^"), unit, F.lit("/"), unit, F.lit("$"))


def transferred(spark, sf_dir, rules: str) -> DataFrame:
    return digest(streamops.apply(tok.text_streams(documents(spark, sf_dir), cased), partial(transfer.transfer, transfer.RuleSet(rules))))


_FIRST = "f AS (SELECT doc_id, pos, surface, lemma, tags[1] AS tag FROM t)"

VALUES = """<transfer default="lu">
 <section-def-cats><def-cat n="noun"><cat-item tags="n"/></def-cat><def-cat n="verb"><cat-item tags="vblex"/></def-cat>
  <def-cat n="adverb"><cat-item tags="adv"/></def-cat><def-cat n="quality"><cat-item lemma="" tags="adj"/></def-cat></section-def-cats>
 <section-def-attrs><def-attr n="kind"><attr-item tags="n"/><attr-item tags="vblex"/></def-attr></section-def-attrs>
 <section-def-vars><def-var n="held" v="x"/><def-var n="count"/><def-var n="shape"/></section-def-vars>
 <section-def-macros><def-macro n="note" npar="1">
   <let><var n="held"/><concat><lit v="m"/><clip pos="1" side="tl" part="lem"/></concat></let>
   <append n="held"><lit v="z"/></append></def-macro></section-def-macros>
 <section-rules>
  <rule><pattern><pattern-item n="noun"/></pattern><action>
   <call-macro n="note"><with-param pos="1"/></call-macro>
   <let><var n="shape"/><case-of pos="1" side="sl" part="lem"/></let>
   <out><lu><get-case-from pos="1"><lit v="thing"/></get-case-from><clip pos="1" side="tl" part="kind"/><lit-tag v="a.b"/><clip pos="1" side="tl" part="kind" link-to="3"/></lu>
    <b/><lu><var n="held"/><lit v="&lt;"/><var n="shape"/><lit v="&gt;"/></lu></out></action></rule>
  <rule><pattern><pattern-item n="verb"/></pattern><action>
   <let><clip pos="1" side="tl" part="lem"/><lit v="do"/></let>
   <modify-case><clip pos="1" side="tl" part="lem"/><lit v="AA"/></modify-case>
   <let><clip pos="1" side="tl" part="lemq"/><lit v="Q"/></let>
   <out><lu><clip pos="1" side="tl" part="whole"/></lu></out></action></rule>
  <rule><pattern><pattern-item n="adverb"/></pattern><action>
   <append n="count"><lit v="x"/></append>
   <out><lu><clip pos="1" side="tl" part="lemh"/><lit v="&lt;"/><var n="count"/><lit v="&gt;"/></lu></out></action></rule>
  <rule><pattern><pattern-item n="quality"/></pattern><action>
   <out><mlu><lu><clip pos="1" side="tl" part="lem"/><lit-tag v="adj"/></lu><lu><lit v="and"/><lit-tag v="cnj"/></lu></mlu></out></action></rule>
 </section-rules></transfer>"""


@query(f"""WITH {TOKENS}, {_CASES}, {_FIRST}, a AS (SELECT *, sum((f.tag = 'adv')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS adverbs FROM f JOIN (SELECT doc_id, pos, shape FROM w) USING (doc_id, pos)),
{_joined("CASE tag WHEN 'n' THEN '^' || CASE shape WHEN 'aa' THEN 'thing' WHEN 'AA' THEN 'THING' ELSE 'Thing' END || '<n><a><b><3>$ ^m' || surface || 'z<' || shape || '>$' WHEN 'vblex' THEN '^DO<vblex>$' WHEN 'adv' THEN '^' || surface || '<' || repeat('x', adverbs::BIGINT) || '>$' WHEN 'adj' THEN '^' || surface || '<adj>+and<cnj>$' ELSE '^' || surface || '<' || tag || '>$' END", "a")}""")
def q_rule_values(spark, sf_dir):
    """Clips, links, literals, variables that live on in a segment, macros, case, assignments that match nothing."""
    return transferred(spark, sf_dir, VALUES)


def _when(test: str, name: str) -> str:
    return f'<when><test>{test}</test><out><lu><lit v="{name}"/><clip pos="1" side="tl" part="tags"/></lu></out></when>'


_LEM = '<clip pos="1" side="sl" part="lem"/>'
TESTS = f"""<transfer default="lu">
 <section-def-cats><def-cat n="any"><cat-item tags="*"/></def-cat></section-def-cats>
 <section-def-lists><def-list n="small"><list-item v="der"/><list-item v="La"/><list-item v="AND"/></def-list>
  <def-list n="heads"><list-item v="An"/><list-item v="re"/></def-list><def-list n="ends"><list-item v="en"/><list-item v="st"/></def-list></section-def-lists>
 <section-rules><rule><pattern><pattern-item n="any"/></pattern><action><choose>
  {_when(f'<equal caseless="yes">{_LEM}<lit v="THE"/></equal>', "equal")}
  {_when(f'<and><begins-with>{_LEM}<lit v="th"/></begins-with><not><ends-with>{_LEM}<lit v="e"/></ends-with></not></and>', "and")}
  {_when(f'<or><ends-with caseless="yes">{_LEM}<lit v="ING"/></ends-with><contains-substring caseless="yes">{_LEM}<lit v="QU"/></contains-substring></or>', "or")}
  {_when(f'<in caseless="yes">{_LEM}<list n="small"/></in>', "in")}
  {_when(f'<begins-with-list caseless="yes">{_LEM}<list n="heads"/></begins-with-list>', "heads")}
  {_when(f'<ends-with-list>{_LEM}<list n="ends"/></ends-with-list>', "ends")}
  <otherwise><out><lu><clip pos="1" side="tl" part="whole"/></lu></out></otherwise></choose></action></rule></section-rules></transfer>"""


@query(f"""WITH {TOKENS}, {_FIRST}, {_joined("'^' || CASE WHEN lemma = 'the' THEN 'equal' WHEN starts_with(surface, 'th') AND NOT ends_with(surface, 'e') THEN 'and' WHEN ends_with(lemma, 'ing') OR contains(lemma, 'qu') THEN 'or' WHEN lemma IN ('der', 'la', 'and') THEN 'in' WHEN starts_with(lemma, 'an') OR starts_with(lemma, 're') THEN 'heads' WHEN ends_with(surface, 'en') OR ends_with(surface, 'st') THEN 'ends' ELSE surface END || '<' || tag || '>$'", "f")}""")
def q_rule_tests(spark, sf_dir):
    """All tests of the rule language, with and without case, in a choice of the first that holds."""
    return transferred(spark, sf_dir, TESTS)


def _rule(names: list[str], action: str) -> str:
    return f"<rule><pattern>{''.join(f'<pattern-item n={chr(34)}{n}{chr(34)}/>' for n in names)}</pattern><action>{action}</action></rule>"


def _out(name: str, tag: str) -> str:
    return f'<out><lu><lit v="{name}"/><lit-tag v="{tag}"/></lu></out>'


_SECOND = '<clip pos="2" side="sl" part="lem"/>'
MATCHING = f"""<transfer default="lu">
 <section-def-cats><def-cat n="adverb"><cat-item tags="adv"/></def-cat><def-cat n="thing"><cat-item tags="n"/></def-cat>
  <def-cat n="named"><cat-item lemma="the" tags="*"/><cat-item lemma="de*" tags="n"/></def-cat></section-def-cats>
 <section-rules>
  {_rule(["adverb", "thing"], f'<choose><when><test><begins-with>{_SECOND}<lit v="t"/></begins-with></test><reject-current-rule shifting="yes"/></when><when><test><begins-with>{_SECOND}<lit v="a"/></begins-with></test><reject-current-rule shifting="no"/></when></choose>' + _out("pair", "adv"))}
  {_rule(["named"], _out("named", "n"))}
  {_rule(["thing"], _out("noun", "n"))}
  {_rule(["adverb"], _out("solo", "adv"))}
 </section-rules></transfer>"""


@query(f"""WITH {TOKENS}, {_FIRST}, o AS (SELECT *, lead(tag) OVER d AS tag2, lead(surface) OVER d AS surface2, lag(tag) OVER d AS tag0 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, pos, CASE WHEN tag = 'adv' AND tag2 = 'n' AND starts_with(surface2, 't') THEN '^' || surface || '<adv>$' WHEN tag = 'adv' AND tag2 = 'n' AND NOT starts_with(surface2, 'a') THEN '^pair<adv>$' WHEN tag = 'adv' THEN '^solo<adv>$'
 WHEN tag = 'n' AND tag0 = 'adv' AND NOT starts_with(surface, 't') AND NOT starts_with(surface, 'a') THEN NULL WHEN tag = 'n' AND (lemma = 'the' OR starts_with(lemma, 'de') AND length(lemma) > 2) THEN '^named<n>$' WHEN tag = 'n' THEN '^noun<n>$' ELSE '^' || surface || '<' || tag || '>$' END AS piece FROM o),
{_joined("piece", "p")}""")
def q_rule_matching(spark, sf_dir):
    """Categories by lemma and tags, the longest match, the first of equal rules, and rejections that pass a word on or try the next rule."""
    return transferred(spark, sf_dir, MATCHING)


@query(f"""WITH {TOKENS}, {_FIRST}, c AS (SELECT DISTINCT lemma, tag FROM f) SELECT lemma, tag, array_to_string(list_filter([CASE WHEN tag = 'adv' THEN 'adverb' END, CASE WHEN lemma = 'the' OR tag = 'n' AND starts_with(lemma, 'de') AND length(lemma) > 2 THEN 'named' END, CASE WHEN tag = 'n' THEN 'thing' END], lambda x: x IS NOT NULL), '|') AS categories FROM c""")
def q_rule_categories(spark, sf_dir):
    """The categories of a rule file that each distinct form is in."""
    rules = transfer.RuleSet(MATCHING)
    held = streamops.on("form", lambda form: "|".join(sorted(rules.categories_of(form))))
    forms = toks(spark, sf_dir).select("lemma", F.element_at("tags", 1).alias("tag")).distinct()
    return forms.withColumn("form", F.concat("lemma", F.lit("<"), "tag", F.lit(">"))).select("lemma", "tag", held.alias("categories"))


def chunks(surface: F.Column) -> F.Column:
    """A chunk of the word and another one."""
    return F.concat(F.lit("^np<SN><sg>{^"), F.lower(surface), F.lit("<n><2>$ ^x<adj>$}$"))


CHUNKS = """<interchunk><section-def-cats><def-cat n="SN"><cat-item tags="SN.*"/></def-cat></section-def-cats>
 <section-def-attrs><def-attr n="number"><attr-item tags="sg"/><attr-item tags="pl"/></def-attr></section-def-attrs>
 <section-rules><rule><pattern><pattern-item n="SN"/></pattern><action>
  <let><clip pos="1" part="number"/><lit-tag v="pl"/></let>
  <out><chunk><clip pos="1" part="lem"/><clip pos="1" part="number"/><lit v="{"/><clip pos="1" part="content"/><lit v="}"/></chunk></out></action></rule></section-rules></interchunk>"""


@query(f"WITH {TOKENS}, {_joined(chr(39) + '^np<pl>{^' + chr(39) + ' || lemma || ' + chr(39) + '<n><2>$ ^x<adj>$}$' + chr(39), 't')}")
def q_chunk_rules(spark, sf_dir):
    """Chunks: parts of the head, an assignment to it, and the content without its braces."""
    return digest(streamops.apply(tok.text_streams(documents(spark, sf_dir), chunks), partial(transfer.interchunk, transfer.RuleSet(CHUNKS))))


WORDS_OF_CHUNKS = """<postchunk><section-def-cats><def-cat n="np"><cat-item name="np"/></def-cat></section-def-cats>
 <section-rules><rule><pattern><pattern-item n="np"/></pattern><action>
  <out><lu><lit v="c"/><lu-count/><clip pos="0" part="tags"/></lu><b/><lu><clip pos="1" part="whole"/></lu></out></action></rule></section-rules></postchunk>"""


@query(f"WITH {TOKENS}, {_joined(chr(39) + '^c2<SN><sg>$ ^' + chr(39) + ' || lemma || ' + chr(39) + '<n><sg>$' + chr(39), 't')}")
def q_postchunk_rules(spark, sf_dir):
    """The number of words of a chunk, the chunk itself as position 0, and tags linked to it."""
    return digest(streamops.apply(tok.text_streams(documents(spark, sf_dir), chunks), partial(transfer.postchunk, transfer.RuleSet(WORDS_OF_CHUNKS))))


def _titled(surface: F.Column) -> F.Column:
    return F.concat(F.lit("^"), surface, F.lit("<SN>{^word# on<n>$ ^(other<adj>$}$"))


@query(f"WITH {TOKENS}, {_CASES}, {_joined(chr(39) + '^' + chr(39) + ' || CASE shape WHEN ' + chr(39) + 'AA' + chr(39) + ' THEN ' + chr(39) + 'WORD# ON<n>$ ^(OTHER<adj>$' + chr(39) + ' WHEN ' + chr(39) + 'Aa' + chr(39) + ' THEN ' + chr(39) + 'Word# on<n>$ ^(other<adj>$' + chr(39) + ' ELSE ' + chr(39) + 'word# on<n>$ ^(other<adj>$' + chr(39) + ' END', 'w')}")
def q_chunk_case(spark, sf_dir):
    """A chunk's case on its words, tags left alone."""
    return digest(streamops.apply(tok.text_streams(documents(spark, sf_dir), _titled), partial(transfer.postchunk, transfer.RuleSet("<postchunk/>"))))


@query(f"WITH {TOKENS}, {_CASES}, x AS (SELECT DISTINCT surface, '(' || lemma || 'ß' AS l FROM t), y AS (SELECT surface, l, CASE WHEN NOT (left(surface, 1) = upper(left(surface, 1)) AND left(surface, 1) <> lower(left(surface, 1))) THEN 'aa' WHEN length(surface) > 1 AND right(surface, 1) = upper(right(surface, 1)) AND right(surface, 1) <> lower(right(surface, 1)) THEN 'AA' ELSE 'Aa' END AS shape FROM x) SELECT surface, CASE WHEN NOT regexp_matches(surface, '^\\p{{L}}') THEN l WHEN shape = 'AA' THEN replace(upper(l), 'ẞ', 'ß') WHEN shape = 'Aa' THEN '(' || replace(upper(substr(l, 2, 1)), 'ẞ', 'ß') || substr(l, 3) ELSE l END AS target FROM y")
def q_copycase_words(spark, sf_dir):
    """The case of each word put on itself between a mark and a letter without an upper case of its length."""
    rows = toks(spark, sf_dir).select("surface", "lemma").distinct()
    return rows.select("surface", copycase_col(F.col("surface"), F.concat(F.lit("("), "lemma", F.lit("ß"))).alias("target"))


@query(f"WITH {TOKENS}, d AS (SELECT doc_id, pos, surface, lemma, CASE WHEN len(tags) > 1 THEN list_filter(tags, lambda x: x <> 'n') ELSE tags END AS tags FROM t), u AS (SELECT doc_id, pos, '^' || CASE WHEN len(tags) > 1 THEN '=' ELSE '' END || surface || '/' || array_to_string(list_transform(tags, lambda x: lemma || '<' || x || '>'), '/') || '$' AS lu FROM d), s AS (SELECT doc_id, '[<STREAMCMD:SETVAR:style=plain>]' || string_agg(lu, ' ' ORDER BY pos) AS stream FROM u GROUP BY doc_id) {_STREAM}")
def q_reading_choice(spark, sf_dir):
    """Readings discarded while others remain, the first chosen and shown with its surface and mark, a setting before."""

    def step(text: str) -> str:
        units = parse(streamops.discard_readings(text, [re.compile(r".*<n>")]))
        shown = (u.blank + streamops.choose(u, u.body.split("/")[1], True, True, True) if u.body is not None else u.blank for u in units)
        held = streamops.with_setvar("".join(shown), {"style": "plain"})
        bare, found = streamops.without_setvar(held)
        return streamops.with_setvar(bare, found)

    return digest(streamops.apply(tok.text_streams(documents(spark, sf_dir)), step))


SPEC = """<tagger name="demo"><tagset>
 <def-label name="THE" closed="true"><tags-item lemma="the" tags="n"/></def-label>
 <def-label name="NOUN"><tags-item tags="n"/></def-label>
 <def-label name="VERB"><tags-item tags="vblex.*"/></def-label>
 <def-label name="ADJADV"><tags-item tags="adj"/><tags-item tags="adv"/></def-label>
</tagset></tagger>"""


@query(f"WITH {TOKENS}, x AS (SELECT doc_id, lemma, unnest(tags) AS tag FROM t) SELECT CASE WHEN lemma = 'the' AND tag = 'n' THEN 'THE' WHEN tag = 'n' THEN 'NOUN' WHEN tag = 'vblex' THEN 'VERB' WHEN tag IN ('adj', 'adv') THEN 'ADJADV' ELSE 'TAG_kUNDEF' END AS label, count(*) AS n FROM x GROUP BY 1")
def q_coarse_tags(spark, sf_dir):
    """Readings by the labels of a tagger specification; distinct readings are classified once."""
    spec = TagSpec.parse(SPEC)
    rows = toks(spark, sf_dir).select("lemma", F.explode("tags").alias("tag")).groupBy("lemma", "tag").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("reading", F.concat("lemma", F.lit("<"), "tag", F.lit(">")))
    return rows.select(streamops.on("reading", spec.coarse).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))


# corpora


@query(f"WITH {TOKENS} SELECT class, tags[pos % len(tags) + 1] AS gold, count(*) AS n FROM t GROUP BY 1, 2")
def q_zip_corpora(spark, sf_dir):
    rows = toks(spark, sf_dir)
    tagged = gold(rows).select("doc_id", "pos", "surface", "gold")
    return lookups.zip_corpora(tagged, rows.select("doc_id", "pos", "surface", "class"), ("doc_id", "pos")).groupBy("class", "gold").agg(F.count(F.lit(1)).alias("n"))


_SENTENCES = f"{TOKENS}, se AS (SELECT *, coalesce(sum((class = 'sent')::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM t)"


@query(f"WITH {_SENTENCES}, b AS (SELECT DISTINCT doc_id, sent_id FROM se WHERE surface <> lemma) SELECT doc_id, count(DISTINCT sent_id) AS sentences, count(*) AS words FROM se ANTI JOIN b USING (doc_id, sent_id) GROUP BY 1")
def q_matching_sentences(spark, sf_dir):
    """Sentences whose words are written alike in a corpus and in its lower-cased copy."""
    rows = tok.sentences(toks(spark, sf_dir)).withColumn("sentence", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sent_id").cast("string")))
    kept = lookups.matching_sentences(rows, rows.select("sentence", "pos", F.col("lemma").alias("surface")), "sentence")
    return kept.groupBy("doc_id").agg(F.countDistinct("sent_id").alias("sentences"), F.count(F.lit(1)).alias("words"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, CAST(len(list_filter(list_intersect(list_distinct(aw), list_distinct(bw)), lambda w: length(w) > 3)) AS BIGINT) AS n FROM q WHERE len(list_filter(list_intersect(list_distinct(aw), list_distinct(bw)), lambda w: length(w) > 3)) > 0")
def q_lexicon_matches(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir).withColumn("pair_id", F.struct("conv_id", "turn"))
    words = rows.select(F.explode(F.array_union("aw", "bw")).alias("source")).distinct().where(F.length("source") > 3)
    pairs = rows.select("pair_id", F.col("aw").alias("source"), F.col("bw").alias("target"))
    return align.lexicon_matches(pairs, words.withColumn("target", F.col("source"))).select("pair_id.*", "n")


PHRASES = (("of the", "of|the"), ("and in", "and|in"), ("de la", "de|la"), ("und der", "und|der"), ("the of the", "the|of"))


@query(f"WITH {_TURNS}, ph AS (SELECT * FROM (VALUES {', '.join(f'{(i, w)}' for i, w in PHRASES)}) AS v(phrase, words)) SELECT conv_id, turn, phrase FROM q JOIN ph ON list_has_all(aw, string_split(words, '|'))")
def q_phrase_matches(spark, sf_dir):
    phrases = spark.createDataFrame([(i, i.split()) for i, _ in PHRASES], "phrase_id string, words array<string>")
    rows = turn_pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("sent_id"), F.col("aw").alias("words"))
    return align.phrase_matches(rows, phrases).select("sent_id.*", F.col("phrase_id").alias("phrase"))


@query(f"WITH {_TURNS}, f AS (SELECT w, count(*) AS n FROM (SELECT unnest(bw) AS w FROM q) GROUP BY 1), l AS (SELECT DISTINCT aw[1] AS source, bw[1:1 + turn % 3] AS target FROM q WHERE len(aw) > 0 AND len(bw) > 0), r AS (SELECT source, array_to_string(target, ' ') AS t, row_number() OVER (PARTITION BY source ORDER BY len(target), coalesce(n, 0) DESC, array_to_string(target, ' ')) AS k FROM l LEFT JOIN f ON f.w = target[1]) SELECT source, t AS target FROM r WHERE k = 1")
def q_one_word_dictionary(spark, sf_dir):
    rows = turn_pairs(spark, sf_dir)
    frequencies = rows.select(F.explode("bw").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where((F.size("aw") > 0) & (F.size("bw") > 0))
    lexicon = first.select(F.col("aw")[0].alias("source"), F.slice("bw", F.lit(1), (F.col("turn") % 3 + 1).cast("int")).alias("target")).distinct()
    return align.one_word_dictionary(lexicon, frequencies)


_SPLIT = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?s)\[(?:\\.|[^\]\\])*\]', '<ph/>', 'g'), '([?!])', '\1' || chr(1), 'g'), '(\.)(<ph/>|\s|$)', '\1' || chr(1) || '\2', 'g')"""


@query(rf"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_SPLIT}, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, CAST(len(parts) AS INTEGER) AS sentences, md5(array_to_string(parts, '|')) AS digest FROM p")
def q_split_sentences(spark, sf_dir):
    parts = streamops.on("text", lambda text: "\x01".join(align.split_sentences(text)))
    rows = documents(spark, sf_dir).select("doc_id", F.filter(F.split(parts, "\x01"), lambda x: x != "").alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("sentences"), F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


@query(rf"WITH {_TURNS} SELECT conv_id, turn, len(regexp_extract_all(regexp_extract(a, '(\p{{L}}.*)', 1), ' ')) > 2 AS unit, md5(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(a, '^\s+|\s+$', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\.+$', ''), '\s+$', '')) AS digest FROM q")
def q_units(spark, sf_dir):
    """Which turns can be units of a translation memory, and their escaped and trimmed text."""
    rows = turn_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", align.unit_col(F.col("a")).alias("unit"), F.md5(streamops.on("a", align.xml_unit).cast("binary")).alias("digest"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, md5(array_to_string(list_sort(aw), ' ')) AS digest FROM q")
def q_sorted_words(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(F.array_sort("aw"), " ").cast("binary")).alias("digest"))


# dictionaries and accents


@query("SELECT doc_id, lang, CASE WHEN source IS NULL THEN NULL WHEN source = 'src0' OR lang = 'src0' THEN 'src0' ELSE 'other' END AS variant FROM documents")
def q_variant_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("source").isNotNull(), F.array("source", "lang")).alias("v"))
    return dictionary.mark_variants(rows, "src0").select("doc_id", "lang", F.element_at("v", 1).alias("variant"))


@query("SELECT DISTINCT lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '__' || CAST(doc_id % 3 AS VARCHAR) END AS marked, source AS target FROM documents")
def q_lexical_choice(spark, sf_dir):
    sense = F.when(F.col("doc_id") % 3 == 0, F.lit("D")).otherwise((F.col("doc_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), sense.alias("sense"), F.col("source").alias("target"))
    return dictionary.lexical_choice(rows, bilingual=True).distinct()


def _accents_sql() -> str:
    """Every letter of the two tables replaced by its command, one after another."""
    text = "text"
    for command, mark in formats.ACCENTS.items():
        for base in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            letter = unicodedata.normalize("NFC", base + mark)
            if len(letter) == 1 and letter not in formats.LETTERS.values():
                text = f"replace({text}, '{letter}', '\\{command.replace(chr(39), chr(39) * 2)}{{{base}}}')"
    for command, letter in formats.LETTERS.items():
        text = f"replace({text}, '{letter}', '\\{command}{{}}')"
    return text


@query(f"WITH s AS (SELECT doc_id, text, {_accents_sql()} AS stream FROM documents) SELECT doc_id, md5(stream) AS digest, CAST(length(stream) AS INTEGER) AS chars, md5(text) AS back FROM s")
def q_accents(spark, sf_dir):
    """Letters with accents as commands, and back."""
    rows = documents(spark, sf_dir).withColumn("stream", streamops.on("text", formats.text_to_accents))
    back = F.md5(streamops.on("stream", formats.accents_to_text).cast("binary"))
    return digest(rows).join(rows.select("doc_id", back.alias("back")), "doc_id")
