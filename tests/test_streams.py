"""Streams, filters, capitals: small cases and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswork.functions import case, stream
from glosswork.operators import caps, streamops

WORDS = st.text("abcXYZé0 ^$/\\[]{}<>@", min_size=1, max_size=12)


@given(st.lists(st.tuples(WORDS, WORDS), max_size=6))
@settings(max_examples=150, deadline=None)
def test_parse_and_render_are_inverse(pairs):
    text = "".join(f"[{stream.escape(b)}] [[t:i:{k}]]^{stream.escape(w)}<n>$" for k, (b, w) in enumerate(pairs)) + " end"
    units = stream.parse(text)
    assert stream.render(units) == text and len(units) == len(pairs) + 1
    assert [stream.unescape(u.body[:-3]) for u in units[:-1]] == [w for _, w in pairs]


def test_chunks_and_blanks():
    (chunk, rest) = stream.parse("x [b]^np<SN><sg>{[[t:b:1]]^dog<n>$ ;^big<adj>$}$ y")
    assert (chunk.blank, chunk.body, chunk.content, rest.blank) == ("x [b]", "np<SN><sg>", "[[t:b:1]]^dog<n>$ ;^big<adj>$", " y")
    assert stream.parse("[[a; b]]^w<n>$")[0].wblank == "a; b" and stream.parse("[[/]]^w<n>$")[0].wblank == ""
    assert list(stream.segments("a\0b")) == ["a", "b"]


def test_morphemes_and_readings():
    assert stream.readings("runs/run<n><pl>/run<vblex>/*x") == ("runs", ["run<n><pl>", "run<vblex>"])
    a, b = stream.morphemes("give<vblex>+it<prn># up")
    assert (a.lemma, a.tags, a.queue, b.lemma, b.queue) == ("give", ("vblex",), "# up", "it", "")
    assert stream.split_outside_tags("a<m/f>/b\\/c") == ["a<m/f>", "b\\/c"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("^go<vblex>$", "^go<vblex>$"),
        ("^go<vblex>+it<prn>$", "^go<vblex>$ ^it<prn>$"),
        ("^take<vblex><past># away$", "^take# away<vblex><past>$"),
        ("[<b>]^take<vblex>+it<prn>+on<pr># away$", "[<b>]^take# away<vblex>$ ^it<prn>$ ^on<pr>$"),
        ("[[t:i:9]]^go<vblex>+it<prn>$", "[[t:i:9]]^go<vblex>$ [[t:i:9]]^it<prn>$"),
        (r"^uno\^dos<num>$", r"^uno\^dos<num>$"),
        ("^*unknown+word$ x", "^*unknown+word$ x"),
    ],
)
def test_pretransfer(given, expected):
    assert streamops.pretransfer(given) == expected


def test_pretransfer_options():
    assert streamops.pretransfer("^Haus/haus<n><nt>$", no_surface=True) == "^haus<n><nt>$"
    assert streamops.pretransfer("^a<n>~b<n>$", compounds=True) == "^a<n>$^b<n>$"


def test_cleanstream():
    given = "before ^ich<prn>$ and ^gehe<vblex>$$ [br]^heim<adv>$ after"
    assert streamops.cleanstream(given) == " ^ich<prn>$ ^gehe<vblex>$  ^heim<adv>$"
    assert streamops.cleanstream(given, newline=True).split() == ["^ich<prn>$", "^gehe<vblex>$", "^heim<adv>$"]
    assert "[br]" in streamops.cleanstream(given, keep_blanks=True) and streamops.cleanstream("") == ""


def test_word_bound_blanks():
    text = "[[t:i:1]]^a<n>$ [[t:b:2]]^b<n>$[[/]] ^c<n>$[[/]] ^d<n>$"
    attached = streamops.attach_wblanks(text)
    assert attached == "[[t:i:1]]^a<n>$ [[t:i:1; t:b:2]]^b<n>$ [[t:i:1]]^c<n>$ ^d<n>$"
    assert streamops.detach_wblanks(attached) == "[[t:i:1]]^a<n>$[[/]] [[t:i:1; t:b:2]]^b<n>$[[/]] [[t:i:1]]^c<n>$[[/]] ^d<n>$"
    assert streamops.join_wblanks("a; b", "b;c") == "a; b; c" and streamops.posttransfer("a  b   c") == "a b c"


def test_case_of_words():
    assert [case.getcase(w) for w in ("", "a", "aB", "A", "Ab", "AbC", "AB", "1a")] == ["aa", "aa", "aa", "Aa", "Aa", "AA", "AA", "aa"]
    assert [case.copycase(s, "wOrd") for s in ("xx", "Xx", "XX", "")] == ["word", "Word", "WORD", "wOrd"]
    assert case.copycase_lemmas("AA", "be<vblex># on") == "BE<vblex># on" and case.apply_case("AA", "straße") == "STRAßE"


@pytest.mark.parametrize(("surface", "lemma", "note"), [("dog", "dog", "aa/aa"), ("Dog", "dog", "Aa/aa"), ("DOG", "Dog", "AA/Aa"), ("DoG", "dOG", "AA/aa"), ("dOG", "DOG", "aa/AA")])
def test_extract_caps(surface, lemma, note):
    assert streamops.extract_caps(f"^{surface}/{lemma}<n>/x<vblex>$") == f"[[c:{note}]]^{lemma}<n>$"
    assert streamops.extract_caps(f"[[t:i:1]]^{surface}/{lemma}<n>$", keep_surface=True) == f"[[t:i:1; c:{note}]]^{surface}/{lemma}<n>$"


def test_extract_caps_of_compounds():
    assert streamops.extract_caps("^Nord-NATO/Nord-<np><cmp>+NATO<np>$") == "[[c:AA/AA]]^Nord-<np><cmp>+NATO<np>$"


#: German: nouns are upper case, names and what was shouted stay as they were written.
CAPS = """<capitalization><rules>
 <rule weight="1"><match tags="n.*" select="Aa"/></rule>
 <rule weight="3"><match lemma="eBay" select="dix"/></rule>
 <rule weight="2"><begin/><match select="Aa"/></rule>
 <rule weight="5"><repeat from="3" upto="3"><match srcsurf="AA" select="AA"/></repeat></rule>
</rules></capitalization>"""


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("^der<det>/der$ ^hund<n><m>/hund$ ^laufen<vblex>/läuft$", "Der Hund läuft"),
        ("^bei<pr>/bei$ ^eBay<np>/eBay$, ^dort<adv>/dort$", "Bei eBay, dort"),
        ("[[c:AA/aa]]^komm<vblex>/komm$ [[c:AA/aa]]^sofort<adv>/sofort$ [[c:AA/aa]]^heim<adv>/heim$ [[c:aa/aa]]^bitte<ij>/bitte$", "KOMM SOFORT HEIM bitte"),
        ("[[c:AA/aa]]^ach<ij>/ach$ [[c:AA/aa]]^so<adv>/so$", "Ach so"),
        ("", ""),
    ],
)
def test_restore_caps(given, expected):
    rules = caps.CapsRules(CAPS)
    assert caps.restore_caps(given, rules) == expected
    kept = caps.restore_caps(given, rules, keep_blanks=True)
    assert re.sub(r"\[\[[^\]]*\]\]", "", kept) == expected


def test_caps_rules_that_do_not_compile():
    for bad in ('<match lemma="a" trglem="aa"/>', '<match select="BB"/>', "<other/>"):
        with pytest.raises(caps.CapsError):
            caps.CapsRules(f"<capitalization><rules><rule>{bad}</rule></rules></capitalization>")


def test_choices_and_commands():
    (unit, _) = stream.parse("^runs/run<n>/run<vblex>$")
    assert streamops.choose(unit, "run<n>") == "^run<n>$" and streamops.choose(unit, "run<n>", True, True, True) == "^=runs/run<n>/run<vblex>$"
    assert streamops.choose(stream.parse("^zzz/*zzz$")[0], None) == "^*zzz$"
    assert streamops.discard("a/b<n>/c<vblex>", [re.compile(".*<n>"), re.compile(".*<vblex>")]) == "a/c<vblex>"
    assert streamops.without_setvar(streamops.with_setvar("^a$", {"k": "v"})) == ("^a$", {"k": "v"})
    with pytest.raises(stream.StreamError):
        streamops.check_segment("a ^b")
    with pytest.raises(stream.StreamError):
        streamops.check_segment("[[t:i:1]] x")


def test_token_tables_round_trip(spark):
    texts = ["[b] ^a/b<n>/c<vblex><past>$ x", "", "[[t:i:1]]^d/*d$", None]
    df = spark.createDataFrame(list(enumerate(texts)), "seg_id long, stream string")
    tokens = streamops.tokens_of(df)
    assert {(r.seg_id, r.pos, r.surface, r.unknown) for r in tokens.collect()} == {(0, 0, "a", False), (0, 1, None, False), (1, 0, None, False), (2, 0, "d", True), (2, 1, None, False)}
    assert {r.seg_id: r.stream for r in streamops.streams_of(tokens, ["seg_id"]).collect()} == {k: t for k, t in enumerate(texts) if t is not None}


def test_token_tables_leave_in_small_batches(spark):
    rows = [(k, ["x", None], "^a/b<n>$ ^c/d<n>+e<po># q$ " * 50 if k % 2 else None) for k in range(40)]
    tokens = streamops.tokens_of(spark.createDataFrame(rows, "seg_id long, other array<string>, stream string"))
    assert "Generate" not in tokens._jdf.queryExecution().executedPlan().toString()  # no row holds all units of a batch's texts
    found = tokens.where("pos = 1").collect()
    assert sorted(r.seg_id for r in found) == list(range(1, 40, 2)) and tokens.count() == 20 * 101
    assert found[0].other == ["x", None] and [(m.lemma, m.tags, m.queue) for m in found[0].readings[0].morphemes] == [("d", ["n"], "# q"), ("e", ["po"], "")]
