"""Formats, containers, alignment, dictionaries, pipelines, streaming."""

import io
import itertools
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswork.operators import align, dictionary, streamops
from glosswork.plans.pipeline import Pipeline, Registry, Step, read_modes, with_word_blanks, write_modes
from glosswork.sources import containers, corpora, formats
from glosswork.streaming import segments


@pytest.mark.parametrize("name", ["txt", "html-noent", "html-alt", "odt", "wxml", "pptx", "xlsx", "xpresstag", "mediawiki"])
@given(st.lists(st.one_of(st.text("ab .\n&;\"'=[]{}^$/\\@~", max_size=8), st.sampled_from(["<p>", "</p>", "<br/>", "<!-- x -->", "<b class='x'>", "<img alt=\"t\"/>", "<w:p>", "<text:p a=\"b\">", "\n\n", "{{x}}"])), max_size=8).map("".join))
@settings(max_examples=40, deadline=None)
def test_documents_come_back(name, text):
    fmt = formats.FORMATS[name]
    if ".[]" not in text and "[]" not in text:
        assert formats.reformat(formats.deformat(text, fmt), formats.reformat_of(name)) == text


def test_blanks_of_html():
    html = formats.FORMATS["html"]
    assert formats.deformat("<p>One &eacute;t&#233; <b>two</b></p>\n<h1>T</h1>x", html) == ".[][<p>]One été[ <b>]two.[][<\\/b><\\/p>\n<h1>]T.[][<\\/h1>]x.[]"
    assert formats.deformat("a <script>b < c</script> d", html) == "a[ <script>b < c<\\/script> ]d.[]"
    assert formats.deformat("<h1>T</h1>x", html, headings=True) == ".[][<h1>]T[]❡.[][<\\/h1>]x.[]"
    assert formats.deformat("a</p>b", html, dot=False) == "a[][<\\/p>]b[]" and formats.deformat("", html) == ".[]"
    assert formats.reformat("café [<a title=\"é\">]", html) == 'caf&eacute; <a title="é">'
    assert formats.deformat('<img alt="One" src="x">', formats.FORMATS["html-alt"]) == '[<img alt="]One.[][" src="x">]'
    assert formats.deformat("a\n\nb", formats.FORMATS["txt"]) == "a.[][\n\n]b.[]"
    warnings = []
    assert formats.format_of("zzz", warnings).name == "txt" and warnings
    assert formats.offsets("a <b>c</b>", html)[0] == {"offset": 1, "order": 1, "tag": " <b>"}


def test_parts_that_formats_skip():
    def blanks(text, name):
        return formats.deformat(text, formats.FORMATS[name])

    for name in ("html", "html-noent", "html-alt"):
        assert blanks("a {{x <b>}} c", name) == "a[ \\{\\{x <b>\\}\\} ]c.[]"
    assert blanks("<script>a <!-- </script> --> b</script>c", "html") == "[<script>a <!-- <\\/script> --> b<\\/script>]c.[]"
    assert blanks("a<script>b <!-- c", "html") == "a.[][<script>b <!-- c]"
    assert blanks("<text:p>It&apos;s <math:mi>x</math:mi> {ok}</text:p>", "odt") == ".[][<text:p>]It's[ <math:mi>x<\\/math:mi> {]ok.[][}<\\/text:p>]"
    assert blanks("<text:tab/>a<text:line-break/>b", "odt") == "[<text:tab\\/>]a[<text:line-break\\/>]b.[]"
    assert blanks("a <w:drawing>x</w:drawing> b", "wxml") == "a.[][ <w:drawing>x<\\/w:drawing> ]b.[]"
    assert blanks("a<Properties>x</Properties>b", "wxml") == "a[<Properties>x<\\/Properties>]b.[]"
    assert blanks("<w:drawing>a<Properties></w:drawing></Properties>b</w:drawing>c", "wxml").endswith("b<\\/w:drawing>]c.[]")
    assert blanks("<si>a</si><f>1+b</f>c", "xlsx") == ".[][<si>]a.[][<\\/si><f>1+b<\\/f>]c.[]"
    assert blanks("a &lt;!-- b --&gt; c", "mediawiki") == "a[ &lt;!-- b --&gt; ]c.[]"
    assert blanks("[[file:x.png]]a [[One|two]] b", "mediawiki") == "[\\[\\[file:x.png\\]\\]]a[ \\[\\[]One|two[\\]\\] ]b.[]"
    assert blanks("== One ==\n* a", "mediawiki") == "[== ]One.[][ ==\n* ]a.[]"


def test_code_pages():
    rtf = formats.FORMATS["rtf-cp1250"]
    assert formats.deformat("\\b\\'9a\\'e1 x", rtf) == "[\\\\b]šá x.[]" and formats.reformat("[\\\\b]šá x.[]", rtf) == "\\b\\'9a\\'e1 x"
    assert formats.deformat("\\'e6", formats.FORMATS["rtf-cp1251"]) == "ж.[]"


def test_latex():
    text = "\\section{On \\'etudes} and $a<b$ \\emph{x} 5\\% % note\n\\begin{itemize}\\item[a] b\\end{itemize} \\verb|x{y|"
    plain = formats.accents_to_text(text)
    assert "études" in plain and formats.postlatex(formats.prelatex(text)) == plain
    stream = formats.deformat_latex(text)
    assert formats.reformat_latex(stream) == plain and stream.startswith(".[][<section\\/><CONTENTS>]On études")
    assert formats.accents_to_text(formats.text_to_accents("çéñößøł")) == "çéñößøł"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_containers(spark, tmp_path):
    data = archive({"mimetype": "x", "content.xml": "<a><text:p>One two</text:p></a>", "styles.xml": "<s/>"})
    back = containers.translate_document(data, "odt", lambda s: s.replace("One", "Uno"))
    with zipfile.ZipFile(io.BytesIO(back)) as z:
        assert z.namelist() == ["mimetype", "content.xml", "styles.xml"] and z.read("content.xml") == b"<a><text:p>Uno two</text:p></a>"
    (tmp_path / "d.odt").write_bytes(data)
    rows = containers.read_documents(spark, str(tmp_path), "odt")
    packed = containers.packed(rows.withColumn("stream", streamops.on("stream", lambda s: s.replace("One two", "ONE TWO"))), "odt").first()
    with zipfile.ZipFile(io.BytesIO(packed.content)) as z:
        assert b"ONE TWO" in z.read("content.xml")


def test_runs_end_where_words_end():
    xml = '<w:p xmlns:w="w"><w:r><w:t>hea</w:t></w:r><w:r><w:rPr/><w:t>vy rain</w:t></w:r><w:r><w:t>s</w:t></w:r><w:r><w:t>!</w:t></w:r></w:p>'
    adapted = containers.adapt_runs(xml)
    assert containers.plain_text(adapted) == containers.plain_text(xml) == "heavy rains!"
    assert "<w:t>heavy</w:t>" in adapted and "rains</w:t>" in adapted and adapted.count("<w:r>") == 3


# alignment


def test_scores():
    assert align.overlap(["a", "a", "b"], ["a", "c"]) == 1 and align.overlap(["12", "a"], ["12", "b"]) == 11 and align.overlap(["12", "13"], ["12", "14"]) == 1
    assert align.identity_score(["<p>"], ["<p>"]) == align.PARAGRAPH_MATCH and align.identity_score(["<p>"], ["a"]) == align.PARAGRAPH_MISMATCH
    assert align.identity_score(["a", "b"], ["a"]) == 1.5 and align.closeness(4, 4) == 0.3 and align.closeness(1, 3) == align.closeness(3, 1)
    assert align.edit_distance("abc", "axc") == 1 and align.edit_distance("abc", "ab") == 2 and align.edit_distance("a" * 90, "b" * 90) == 50
    assert align.similar("short", "other") and align.similar("a" * 40, "a" * 39 + "b") and not align.similar("a" * 40, "b" * 40)


def test_similarity_of_long_texts():
    import random

    def distance(a, b):
        row = [2 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], 2 * i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 2, row[j - 1] + 2)
        return row[-1]

    rng, seen = random.Random(5), set()
    for share in (0.05, 0.2, 0.25, 0.3, 0.35, 0.5, 1.0):
        for size in (210, 300, 420):
            a = "".join(rng.choice("abcdefgh ") for _ in range(size))
            b = "".join(rng.choice(["", "x", "y", c + "z"]) if rng.random() < share else c for c in a)
            d, long = distance(a, b), max(len(a), len(b))
            assert align.edit_distance(a, b, 10**6) == d and align.edit_distance(list(a), list(b), 60) == min(d, 60)
            assert align.similar(a, b) == (min(len(a), len(b)) / long > 0.85 and d < 0.30 * long)
            seen.add(align.similar(a, b))
    assert seen == {True, False} and not align.similar("a" * 400, "b" * 400) and not align.similar("a" * 80, "a" * 1800)


def best_by_trying(source, target):
    def total(path):
        at, sum_ = (0, 0), 0.0
        for di, dj in path:
            if 0 in (di, dj):
                sum_ += align.SKIP
            else:
                sum_ += min(align.identity_score(sorted(source[i]), sorted(target[j])) for i in range(at[0], at[0] + di) for j in range(at[1], at[1] + dj))
                sum_ += align.SKIP if di + dj > 2 else 0
                a = sum(sum(map(len, s)) + len(s) for s in source[at[0] : at[0] + di]) + align.DOT * (di - 1)
                b = sum(sum(map(len, s)) + len(s) for s in target[at[1] : at[1] + dj]) + align.DOT * (dj - 1)
                sum_ += align.closeness(a, b)
            at = (at[0] + di, at[1] + dj)
        return sum_

    def paths(n, m):
        if (n, m) == (0, 0):
            yield ()
        for move in align._MOVES:
            if move[0] <= n and move[1] <= m:
                for rest in paths(n - move[0], m - move[1]):
                    yield (*rest, move)

    return max(total(p) for p in paths(len(source), len(target)))


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=3), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=3), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_alignment_is_the_best(source, target):
    rungs, running = align.align(source, target)
    assert rungs[0] == (0, 0) and rungs[-1] == (len(source), len(target))
    assert abs(running[-1] - best_by_trying(source, target)) < 1e-9
    assert len(align.segment_scores(rungs, running)) == len(rungs) - 1


def test_two_sentences_against_one_by_hand():
    """Skipping b: -0.3 and 3 x 1 / 2, closeness of 2 and 4 characters 0.3 - 0.3 x (5 / 3 - 1); as a
    merge: the worse 1.5 - 0.3 and closeness of 6 and 4 characters."""
    rungs, running = align.align([["a"], ["b"]], [["a", "b"]])
    assert rungs == [(0, 0), (2, 1)] and abs(running[-1] - (1.5 - 0.3 + 0.3 - 0.3 * (7 / 5 - 1))) < 1e-9


def test_numbers_in_overlaps():
    assert align.overlap(["3.5", "x"], ["3.5", "y"]) == 1 and align.overlap(["12%"], ["12%"]) == 1
    assert align.overlap(["7", "8", "9"], ["7"]) == 11  # what comes after the other side's last word doesn't differ
    assert align.overlap(["5", "7"], ["7"]) == 1 and align.overlap(["7"], ["5", "7", "z"]) == 1


def test_alignment_filters(spark):
    assert align.align([["a"]] * 12, [["a"]]) == ([], []) and align.align([], [["a"]]) == ([], [])
    rungs = [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3)]
    assert align.one_to_one(rungs) == [(0, 0), (1, 1), (3, 2)] and align.cautious(rungs) == [(0, 0), (1, 1)]
    assert align.drop_low([(0, 0), (1, 1)], [0.0, -5.0], 0.0) == []
    assert align.space_out([(0, 0), (1, 0), (1, 1), (2, 2)], [5, 5], [5, 5])[0] == (0, 0)
    pairs = spark.createDataFrame([(1, ["One two.", "Three."], ["One two.", "Three."]), (2, None, []), (3, ["a"], ["b"] * 9)], "pair_id long, source array<string>, target array<string>")
    got = {r.pair_id: [tuple(x) for x in r.rungs] for r in align.align_documents(pairs).collect()}
    assert got == {1: [(0, 0), (1, 1), (2, 2)], 2: [], 3: []}


def test_memory_from_two_texts(spark, tmp_path):
    one = "The red house is old. It has a very big & green door! Yes."
    two = "The red house is old. It has a very big & green gate! Yes."
    rows = [(1, one, two), (2, None, two), (3, "", ""), (4, "A cat. " * 12, "A cat."), (5, one, one)]
    got = corpora.build_memory(spark.createDataFrame(rows, "pair_id long, source string, target string"), "x", "y").collect()
    unit = '<tu><tuv xml:lang="x"><seg>{}</seg></tuv><tuv xml:lang="y"><seg>{}</seg></tuv></tu>'
    house, door = "The red house is old", "It has a very big &amp; green {}!"
    assert sorted((r.pair_id, r.step, r.unit) for r in got) == [
        (1, 0, unit.format(house, house)),
        (1, 1, unit.format(door.format("door"), door.format("gate"))),
        (5, 0, unit.format(house, house)),
        (5, 1, unit.format(door.format("door"), door.format("door"))),
    ]
    document = "".join(corpora.tmx_document((r.unit for r in got if r.pair_id == 1), "x"))
    assert corpora.read_tmx(document, "x", "y")[1] == ("It has a very big & green door!", "It has a very big & green gate!")


def test_steps_without_paragraph_marks():
    p = [align.PARAGRAPH]
    source, target = [["a"], p, ["b"]], [["a"], p]
    rungs, running = [(0, 0), (2, 2), (3, 2)], [0.0, 2.31, 2.01]
    assert align.segment_scores(rungs, running) == pytest.approx([1.155, -0.3])
    assert align.segment_scores(rungs, running, source, target) == pytest.approx([2.0, -0.3])
    assert align.segment_scores([(0, 0), (1, 1)], [0.0, 0.31], [p], [p]) == [0.0]
    assert align.segment_scores([(0, 0), (1, 0)], [0.0, -0.3], [p], []) == [0.0]


def test_blanks_and_second_alignment():
    assert align.compatible_blanks("[a]x[b]", "[a] y [b]") and not align.compatible_blanks("[a]x", "x[b]") and align.compatible_blanks("[a]x", "x[b]", lazy=True)
    source, target = [["eins"], ["zwei", "drei"], ["vier"]], [["one"], ["two", "three"], ["four"]]
    scores = align.translated_scores(source, target, {"eins": "one", "zwei": "two", "drei": "three", "vier": "four"})
    assert align.align(source, target, scores=scores)[0] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_units_and_memories(spark):
    assert align.split_sentences("Hi there. [<b>]You? Yes!Go 3.5") == ["Hi there.", "<ph/>You?", "Yes!", "Go 3.5"]
    assert align.xml_unit("<ph/> a < b <ph/>c.") == "a &lt; b <ph/>c" and align.is_unit("One two three four") and not align.is_unit("12 13 14 a b")
    pairs = spark.createDataFrame([("One two three four.", "Eins zwei drei vier."), ("x", "y")], "source string, target string")
    (unit,) = [r.u for r in pairs.select(corpora.unit_column(source_lang="en", target_lang="de").alias("u")).collect() if r.u]
    document = "".join(corpora.tmx_document(iter([unit]), "en"))
    assert corpora.read_tmx(document, "en", "de") == [("One two three four", "Eins zwei drei vier")]
    memory = spark.createDataFrame([("Good  day", "Guten Tag")], "source string, target string")
    found = spark.createDataFrame([("good day ",), ("else",)], "text string")
    assert {r.text: r.translation for r in corpora.apply_memory(found, memory).collect()} == {"good day ": "Guten Tag", "else": None}


def test_statistics(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, ["a"], ["y"]), (3, [], ["z"])], "pair_id long, source array<string>, target array<string>")
    assert {(r.s, r.t): round(r.p, 6) for r in align.model_one(pairs).collect()} == {("a", "x"): 0.333333, ("a", "y"): 0.666667, ("b", "x"): 1.0}
    lexicon = spark.createDataFrame([("a", "x"), ("a", "y"), ("q", "z")], "source string, target string")
    assert {r.pair_id: r.n for r in align.lexicon_matches(pairs, lexicon).collect()} == {1: 1, 2: 1}
    sentences = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "sent_id long, words array<string>")
    phrases = spark.createDataFrame([(7, ["b", "a"]), (8, ["a", "z"])], "phrase_id long, words array<string>")
    assert [(r.sent_id, r.phrase_id) for r in align.phrase_matches(sentences, phrases).collect()] == [(1, 7)]
    assert align.filter_bicorpus(pairs, ["a"]).where("pair_id = 1").first().source == ["a"]
    entries = spark.createDataFrame([("a", ["p", "q"]), ("a", ["r"]), ("a", ["s"])], "source string, target array<string>")
    frequencies = spark.createDataFrame([("r", 1), ("s", 5)], "word string, n long")
    assert align.one_word_dictionary(entries, frequencies).first().target == "s"
    assert align.crude_translation(["b", "the", "a"], {"a": "z"}, frozenset({"the"})) == ["b", "z"]


# dictionaries


def test_variants(spark):
    rows = spark.createDataFrame([(1, ["x", "y"], None), (2, ["y"], "LR"), (3, None, None)], "id long, v array<string>, r string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(dictionary.keep_all_requested(rows, ["x", "y"])) == [1, 3] and ids(dictionary.keep_any_requested(rows, ["x"])) == [1, 3] and ids(dictionary.keep_language(rows, "y", "v")) == [1, 2, 3]
    marked = {r.id: (r.v, m.v) for r in rows.collect() for m in dictionary.mark_variants(rows, "x").collect() if m.id == r.id}
    assert all(new == (None if not old else ["x"] if "x" in old else ["other"]) for old, new in marked.values()) and len(marked) == 3
    senses = spark.createDataFrame([("bank", "D", "banco"), ("bank", "river", "orilla")], "source string, sense string, target string")
    assert {r.marked for r in dictionary.lexical_choice(senses).collect()} == {"bank", "bank__river"}


def test_macros_of_rule_sources():
    xml = '<r><def-macros><def-macro n="m"><match lemma="$1" tags="$2.x"/></def-macro></def-macros><rule><macro n="m"><with-param v="a"/><with-param v="n"/></macro></rule></r>'
    assert dictionary.expand_macros(xml) == '<r><rule><match lemma="a" tags="n.x" /></rule></r>'
    with pytest.raises(ValueError):
        dictionary.expand_macros('<r><macro n="zz"/></r>')


def test_edit_machines():
    def distance(a, b):
        table = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
        return table[len(a), len(b)]

    machine = dictionary.edit_machine("ab", 2)
    words = ["", "a", "ab", "ba", "aab", "bba", "abab"]
    for a, b in itertools.product(words, words):
        found, d = dictionary.accepts(machine, 2, a, b), distance(a, b)
        assert (found is None) == (d > 2) and (found is None or found == d)


# pipelines and streams


def test_pipelines(spark):
    xml = '<modes><mode name="en-de" install="yes"><pipeline><program name="analyse -w"><file name="a.bin"/></program><program name="transfer"><file name="t1x"/><file name="t1x.bin"/><file name="bidix"/></program><program name="generate $1"><file name="g.bin"/></program></pipeline></mode></modes>'
    (mode,) = read_modes(xml)
    assert mode.install and mode.line() == "analyse -w a.bin | transfer t1x t1x.bin bidix | generate $1 g.bin"
    rewritten = with_word_blanks(mode)
    assert [s.program for s in rewritten.steps] == ["analyse", "wblank-attach", "lookup", "transfer", "generate", "wblank-detach"] and all("-z" in s.flags for s in rewritten.steps)
    assert [s.program for s in with_word_blanks(rewritten).steps] == [s.program for s in rewritten.steps]
    assert set(write_modes([mode], untrimmed=True)) == {"en-de", "en-de-analyse", "en-de-transfer", "en-de-untrimmed"}
    registry = Registry()
    registry.register("upper", lambda files, flags: str.upper)
    df = spark.createDataFrame([("[[t:i:1]]^a<n>$[[/]]",), (None,)], "stream string")
    p = Pipeline("p", (Step("wblank-attach"), Step("upper"), Step("wblank-detach")))
    assert [r.stream for r in registry.run(df, p).collect()] == ["[[T:I:1]]^A<N>$[[/]]", None]
    with pytest.raises(KeyError):
        registry.compile(Pipeline("q", (Step("zzz"),)))


def test_streaming_equals_batch(spark, tmp_path):
    texts = [(k, f"a  b   {k}") for k in range(20)] + [(99, None)]
    df = spark.createDataFrame(texts, "doc_id long, stream string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = segments.process(segments.read(spark, str(tmp_path / "in"), "doc_id long, stream string", files_per_trigger=1), streamops.posttransfer)
    segments.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, streamops.apply(df, streamops.posttransfer).collect()))


def test_gathered_parts(spark, tmp_path):
    rows = [(1, 0, "ab"), (1, 1, "c\0d"), (2, 0, "x\0"), (1, 2, "e\0")]
    spark.createDataFrame(rows, "doc_id long, part int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = segments.gather(segments.read(spark, str(tmp_path / "in"), "doc_id long, part int, text string"))
    query = stream.writeStream.format("memory").queryName("gathered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from gathered").collect())) == [(1, "abc"), (1, "de"), (2, "x")]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\0three")
    assert [(r.seg_id, r.text) for r in corpora.read_segments(spark, str(tmp_path / "t")).collect()] == [(0, "one\ntwo"), (1, "three")]
    (tmp_path / "b.tsv").write_text("a b\tc\nonly\n")
    assert [(r.source, r.target) for r in corpora.read_bicorpus(spark, str(tmp_path / "b.tsv")).collect()] == [(["a", "b"], ["c"])]
    (tmp_path / "l.txt").write_text("x y @ z\n")
    assert [(r.source, r.target) for r in corpora.read_lexicon(spark, str(tmp_path / "l.txt")).collect()] == [(["z"], ["x", "y"])]
    raw = spark.createDataFrame([(b"caf\xc3\xa9",), (b"\xff\xfe",)], "content binary")
    assert [r.text for r in corpora.only_utf8(raw).collect()] == ["café"]
    corpora.save_model(spark, str(tmp_path / "m"), corpora.hmm_tables(spark, {"a": {("n", "v"): 1.0}, "b": {("n", "n|v"): 0.5}}))
    assert corpora.load_model(spark, str(tmp_path / "m"), ["emissions"])["emissions"].first().p == 0.5


def test_validation():
    assert corpora.validate("<transfer><section-rules/></transfer>", "transfer") == []
    assert corpora.validate("<transfer><zz/></transfer>", "transfer") and corpora.validate("<a", "modes") and corpora.validate("<tagger/>", "modes")
    assert corpora.validate('<capitalization><rules><rule><match select="zz"/></rule></rules></capitalization>', "capitalization")


def test_all_queries_are_registered():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 55
