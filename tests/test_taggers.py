"""Training and decoding on small corpora, against plain Python."""

import itertools
import math
from collections import Counter, defaultdict

import pytest

from glosswork.operators import lookups, perceptron, tagger, tagspec, tokens as tok

CORPUS = [[("the", "det"), ("cat", "n|vblex"), ("runs", "n|vblex"), (".", "sent")], [("a", "det"), ("red", "adj|n"), ("run", "n|vblex"), (".", "sent")], [("cats", "n"), ("run", "n|vblex"), ("fast", "adj|adv"), (".", "sent"), ("run", "n|vblex")]]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(d, p, w, w, c.split("|"), c) for d, s in enumerate(CORPUS) for p, (w, c) in enumerate(s)]
    return spark.createDataFrame(rows, "doc_id long, pos int, surface string, lemma string, tags array<string>, class string")


@pytest.fixture(scope="module")
def classes(corpus):
    return tagger.ambiguity_classes(corpus)


@pytest.fixture(scope="module")
def model(corpus, classes):
    return tagger.model_of(tagger.kupiec_transitions(corpus, classes), tagger.kupiec_emissions(corpus, classes))


def test_analyser(spark):
    docs = spark.createDataFrame([(1, "The king walked quickly. Best water!"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.surface, r["class"]) for r in tok.tokens(docs).orderBy("doc_id", "pos").collect()]
    assert got == [("The", "n"), ("king", "n|vblex"), ("walked", "adj|vblex"), ("quickly", "adv"), (".", "sent"), ("Best", "adj|adv|n"), ("water", "adj|n"), ("!", "sent")]
    assert [r.sent_id for r in tok.sentences(tok.tokens(docs)).orderBy("pos").collect()] == [0] * 5 + [1] * 3
    assert tok.streams(tok.tokens(docs)).first().stream.startswith("^The/the<n>$ ^king/king<n>/king<vblex>$")


def test_words_by_share(spark):
    vocabulary = spark.createDataFrame([("a", 6), ("b", 2), ("c", 1), ("d", 1)], "word string, n long")
    assert {r.word for r in tok.by_share(vocabulary, 0.4).collect()} == {"b", "c", "d"} and {r.word for r in tok.by_share(vocabulary, 0.7, low=False).collect()} == {"a"}


def test_classes_and_similar_ones(spark, corpus, classes):
    held = {r["class"] for r in classes.collect()}
    assert {"n|vblex", "det", "adj|adv|n|vblex", "sent", "adv"} <= held
    assert {r["class"]: (r.doc_id, r.pos) for r in tagger.first_examples(corpus).collect()}["n|vblex"] == (0, 1)
    wanted = spark.createDataFrame([(c, c.split("|")) for c in ("adj|vblex", "n", "det|n")], "class string, tags array<string>")
    assert {r["class"]: r.similar_class for r in tagger.similar_classes(wanted, classes).collect()} == {"adj|vblex": "adj|adv|n|vblex", "n": "n", "det|n": None}


def test_kupiec_against_python(corpus, classes, model):
    names = [r["class"] for r in classes.collect()]
    pairs = Counter({(a, b): 1 for a in names for b in names})
    single = Counter({a: 1 for a in names})
    for s in CORPUS:
        before = "sent"
        for _, c in s:
            pairs[before, c] += 1
            single[before] += 1
            before = c
    a, b = defaultdict(float), defaultdict(float)
    for (x, y), n in pairs.items():
        for i, j in itertools.product(x.split("|"), y.split("|")):
            a[i, j] += n / (len(x.split("|")) * len(y.split("|")))
    for k, n in single.items():
        for i in k.split("|"):
            b[i, k] += n / len(k.split("|"))
    for table, got in ((a, model["a"]), (b, model["b"])):
        for key, v in table.items():
            assert math.isclose(got[key], v / sum(x for (i, _), x in table.items() if i == key[0]), rel_tol=1e-12)


def test_viterbi_is_the_best_path(corpus, model):
    for run in tagger.runs(corpus).collect():
        path, p, before = tagger.viterbi_run(model, run.start, run.classes), 1.0, run.start
        for tag, class_ in zip(path, run.classes):
            p, before = p * model["a"][before, tag] * model["b"][tag, class_], tag
        assert math.isclose(p, tagger.brute_force_run(model, run.start, run.classes), rel_tol=1e-12)
    tags = {(r.doc_id, r.pos): r.tag for r in tagger.viterbi(corpus, model).collect()}
    assert len(tags) == sum(map(len, CORPUS)) and all(tags[d, p] in c.split("|") for d, s in enumerate(CORPUS) for p, (_, c) in enumerate(s))


def test_expected_counts_against_enumeration(model):
    start, classes = "sent", ["n|vblex", "adj|n", "sent"]
    xi, _, phi, prob = tagger.expected_counts(model, start, classes)
    want_xi, want_phi, total = defaultdict(float), defaultdict(float), 0.0
    for path in itertools.product(*(c.split("|") for c in classes)):
        p = math.prod(model["a"][x, y] * model["b"][y, c] for x, y, c in zip((start, *path), path, classes))
        total += p
        for x, y, c in zip((start, *path), path, classes):
            want_xi[x, y] += p
            want_phi[y, c] += p
    assert math.isclose(prob, total, rel_tol=1e-12)
    assert all(math.isclose(xi[k], v / total, rel_tol=1e-9) for k, v in want_xi.items()) and all(math.isclose(phi[k], v / total, rel_tol=1e-9) for k, v in want_phi.items())


def test_training_raises_the_likelihood(corpus, classes, model):
    likelihoods = []
    for _ in range(4):
        model, log = tagger.baum_welch_step(corpus, model)
        likelihoods.append(log)
        for table in (model["a"], model["b"]):
            sums = defaultdict(float)
            for (i, _), p in table.items():
                sums[i] += p
            assert all(math.isclose(s, 1, rel_tol=1e-9) for s in sums.values())
    assert all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:]))
    ruled = tagger.train_hmm(corpus, classes, 1, forbid=[("n", "n")])
    assert ruled["a"]["n", "n"] < 1e-8


def test_supervised_counts(corpus, classes):
    tagged = corpus.selectExpr("*", "tags[0] as gold")
    tags = ["adj", "adv", "det", "n", "sent", "vblex"]
    a = {(r.tag_i, r.tag_j): r.p for r in tagger.supervised_transitions(tagged, tags).collect()}
    assert math.isclose(a["det", "n"], (1 + 1) / (2 + 6)) and math.isclose(a["sent", "det"], 3 / (4 + 6))
    b = {(r.tag, r["class"]): r.p for r in tagger.supervised_emissions(tagged, classes).collect()}
    with_n = [r["class"] for r in classes.collect() if "n" in r.tags]
    assert math.isclose(b["n", "n|vblex"], (5 + 1 / len(with_n)) / (6 + 1)) and math.isclose(sum(v for (t, _), v in b.items() if t == "n"), 1)


def test_sliding_windows(corpus):
    start = tagger.lsw_initial(corpus)
    total = sum(r.d for r in start.collect())
    assert math.isclose(total, sum(len(s) - 1 for s in CORPUS))
    assert math.isclose(sum(r.d for r in tagger.lsw_step(corpus, start).collect()), total)
    banned = tagger.lsw_initial(corpus, forbid=[("n", "n")])
    assert not [r for r in banned.collect() if (r.l, r.m) == ("n", "n") or (r.m, r.r) == ("n", "n")]
    tags = {(r.doc_id, r.pos): r.tag for r in tagger.lsw_decode(corpus, start).collect()}
    assert len(tags) == sum(len(s) - 1 for s in CORPUS) and tags[0, 0] == "det"


def test_sliding_window_training(corpus):
    assert math.isclose(sum(r.d for r in tagger.train_lsw(corpus, 2).collect()), sum(len(s) - 1 for s in CORPUS))


def test_coefficient_depends_on_the_order():
    assert tagger.coefficient([1, 2, 4]) == 8 and tagger.coefficient([4, 2, 1]) == 4 and tagger.coefficient([]) == 1 and tagger.coefficient([2, 3, 6]) == 6


def test_unigrams(corpus):
    c = tagger.corpus_coefficient(corpus)
    counts = {(r.lemma, r.tag): r.f for r in tagger.unigram_counts(corpus, c).collect()}
    assert c == 2 and counts["run", "n"] == 3 and counts["cat", "vblex"] == 1 and counts["the", "det"] == 2
    table = tagger.unigram_counts(corpus, c)
    two = {(r.lemma, r.tag): r.score for r in tagger.unigram_scores(table, 2).collect()}
    n = {k: v for k, v in counts.items() if k[1] == "n"}
    assert math.isclose(two["run", "n"], (1 + 3) * (1 + sum(n.values())) / (1 + sum(n.values()) + len(n)))
    assert {r.lemma: r.tag for r in tagger.unigram_decode(corpus, tagger.unigram_scores(table)).collect()}["run"] == "n"
    assert math.isclose(tagger.compound_score([("a", "n"), ("b", "adj")], {"n": {"a": 3}}, {"n": {"b": 1}}, {}), 4 * 4 / 5 * (2 * 2 / 3) * (1 / 2))


SPEC = """<tagger><tagset>
 <def-label name="DET" closed="true"><tags-item tags="det.*"/></def-label><def-label name="NOUN"><tags-item tags="n.*"/></def-label>
 <def-label name="VERB"><tags-item tags="vblex.*"/></def-label><def-label name="BE" closed="true"><tags-item lemma="be" tags="vblex.*"/></def-label>
 <def-mult name="VPRN"><sequence><label-item label="VERB"/><tags-item tags="prn.*"/></sequence></def-mult></tagset>
 <forbid><label-sequence><label-item label="DET"/><label-item label="VERB"/></label-sequence></forbid>
 <enforce-rules><enforce-after label="DET"><label-set><label-item label="NOUN"/></label-set></enforce-after></enforce-rules>
 <preferences><prefer tags="n.pl"/></preferences><discard-on-ambiguity><discard tags="vblex.imp"/></discard-on-ambiguity></tagger>"""


def test_tag_specifications():
    spec = tagspec.TagSpec.parse(SPEC)
    assert spec.open_class == ["NOUN", "VERB", "VPRN"] and spec.forbid == [("DET", "VERB")] and spec.enforce == {"DET": ["NOUN"]}
    assert [spec.coarse(r) for r in ("cat<n><sg>", "be<vblex><inf>", "give<vblex>+it<prn><p3>", "give<vblex>+on<pr>", "up<adv>")] == ["NOUN", "VERB", "VPRN", "VERB", tagspec.UNDEFINED]
    (surface, labels), (_, other) = spec.tokens("^sheep/sheep<n><sg>/sheep<n><pl>/sheep<vblex><imp>$ ^go/go<vblex><imp>$")
    assert surface == "sheep" and labels == {"NOUN": "sheep<n><pl>"} and other == {"VERB": "go<vblex><imp>"}
    with pytest.raises(ValueError):
        tagspec.TagSpec.parse(SPEC.replace('label="DET"/>', 'label="ZZ"/>', 1))


def sentences(words):
    """``the X Y .`` and ``we X the Y .``: noun after the article, verb after noun and pronoun."""
    unit = lambda w: f"^{w}/{w}<n>/{w}<vblex>$"
    for x, y in itertools.permutations(words, 2):
        yield f"^the/the<det>$ {unit(x)} {unit(y)} ^./.<sent>$", f"^the/the<det>$ ^{x}/{x}<n>$ ^{y}/{y}<vblex>$ ^./.<sent>$"
        yield f"^we/we<prn>$ {unit(x)} ^the/the<det>$ {unit(y)} ^./.<sent>$", f"^we/we<prn>$ ^{x}/{x}<vblex>$ ^the/the<det>$ ^{y}/{y}<n>$ ^./.<sent>$"


def test_perceptron_remembers_scores_without_changing_them():
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 4)))
    tags = lambda: "".join(f"/{word()}<{rng.choice('nvaq')}>" + ("+x<p>" if rng.random() < 0.2 else "") for _ in range(rng.randrange(4))) or "/*?"
    lines = [" ".join(f"^{word()}{tags()}$" for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    read = [perceptron.sentence_of(x) for x in lines]
    model = perceptron.train([(s, [rng.choice(t.analyses) if t.analyses else () for t in s]) for s in read], perceptron.Templates(perceptron.DEFAULT), 2)
    plain = [model.beam(s)[0] for s in read]
    assert [model.tag(s) for s in read] == plain
    calls = []
    model.score = lambda *a: calls.append(a) or 0.0
    assert [model.tag(s) for s in read] == plain and not calls
    far = perceptron.Templates('<metatag><feat><out><ex-coarse/></out><out><ex-surf><int v="0"/></ex-surf></out></feat></metatag>')
    assert not perceptron.Near.fits(far) and perceptron.Near.fits(model.templates)


def test_perceptron_learns_its_corpus(spark):
    corpus = list(sentences(["run", "walk", "play", "work"]))
    pairs = [(perceptron.sentence_of(u), perceptron.gold_of(t)) for u, t in corpus]
    model = perceptron.train(pairs, perceptron.Templates(perceptron.DEFAULT), 5, seed=3)
    assert [model.tag(s) for s, _ in pairs] == [g for _, g in pairs]
    unseen = [(perceptron.sentence_of(u), perceptron.gold_of(t)) for u, t in sentences(["dance", "talk", "cook"])]
    assert [model.tag(s) for s, _ in unseen] == [g for _, g in unseen]
    assert perceptron.tag_text("[b] " + corpus[0][0] + " ^zz/*zz$", model) == "[b] ^the<det>$ ^run<n>$ ^walk<vblex>$ ^.<sent>$ ^*zz$"
    assert model.weights == perceptron.train(pairs, perceptron.Templates(perceptron.DEFAULT), 5, seed=3).weights
    rows = spark.createDataFrame(corpus, "untagged string, tagged string").repartition(2)
    mixed = perceptron.train_distributed(rows, perceptron.Templates(perceptron.DEFAULT), 2)
    assert perceptron.trace(mixed, spark).count() == len(mixed.weights) > 0
    assert sum(mixed.tag(s) == g for s, g in pairs) > 0.9 * len(pairs)


def test_feature_language():
    xml = """<metatag><beam-width>7</beam-width><def-set n="s"><item v="n"/></def-set><def-str n="c" v="-"/>
      <def-macro n="tag"><subscript><ex-tags/><var n="k"/></subscript></def-macro>
      <global-pred><gt><sentlen/><int v="0"/></gt></global-pred>
      <feat><pred><sethasany><ex-tags/><set n="s"/></sethasany></pred><out><join><slice><ex-tags/><int v="0"/><int v="2"/></slice><str n="c"/></join></out></feat>
      <feat><out><macro n="tag"><param n="k"><int v="-1"/></param></macro></out><out><strlen><ex-surf/></strlen></out></feat>
      <feat><out-many><for-each n="t"><ex-tags/><lower><var n="t"/></lower></for-each></out-many><out><arrlen><ex-tags/></arrlen></out></feat>
      <feat><out><ex-lemma><adjust><addr-of-ints><tokaddr/><int v="-1"/></addr-of-ints></adjust></ex-lemma></out></feat></metatag>"""
    templates = perceptron.Templates(xml)
    sentence = perceptron.sentence_of("^Go/go<v>$ ^cats/cat<n><PL>$")
    chosen = [t.analyses[0] for t in sentence]
    assert templates.beam == 7 and list(perceptron.features(templates, sentence, chosen)) == [("0", "n-PL"), ("1", "PL", "4"), ("2", "n", "2"), ("2", "pl", "2"), ("3", "go")]
    with pytest.raises(ValueError):
        perceptron.Templates("<metatag><feat><out><zzz/></out></feat></metatag>")


def test_lookups_and_zips(spark, corpus):
    dictionary = spark.createDataFrame([("cat", "Katze"), ("run", "Lauf")], "source string, target string")
    extended = spark.createDataFrame([("fast", "schnell")], "source string, target string")
    got = {r.lemma: (r.target, r.status) for r in lookups.bilingual(corpus, dictionary, extended).collect()}
    assert got["cat"] == ("Katze", "found") and got["fast"] == ("%schnell", "extended") and got["the"] == ("@the", "untranslated")
    assert {r.word for r in lookups.unknown_words(corpus, dictionary).collect()} == {"the", "runs", ".", "a", "red", "cats", "fast"}
    one = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "sent_id long, pos int, surface string")
    two = spark.createDataFrame([(1, 0, "a"), (2, 0, "c")], "sent_id long, pos int, surface string")
    assert [r.sent_id for r in lookups.matching_sentences(one, two).collect()] == [1] and lookups.zip_corpora(one, one).count() == 2
    with pytest.raises(Exception, match="surfaces differ"):
        lookups.zip_corpora(one, two).collect()


def test_a_word_that_one_corpus_lacks_stops_the_zip(spark):
    two = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "sent_id long, pos long, surface string")
    for one, other in ((two, two.limit(1)), (two.limit(1), two)):
        with pytest.raises(Exception, match="surfaces differ"):
            lookups.zip_corpora(one, other).collect()


def test_unseen_classes_take_similar_ones_and_unknown_words_the_open_class():
    """By hand: v follows sent much more often than n, and adj|n|v has the emissions of adj|n|v|x."""
    a = {("sent", t): p for t, p in (("adj", 0.1), ("n", 0.2), ("v", 0.7), ("x", 0.0))}
    b = {(t, "adj|n|v|x"): 0.5 for t in ("adj", "n", "v", "x")} | {("v", "v"): 0.5}
    assert tagger.viterbi_run({"a": a, "b": b}, "sent", ["adj|n|v"]) == ["v"]
    a = {("sent", t): p for t, p in (("adj", 0.1), ("adv", 0.4), ("n", 0.3), ("vblex", 0.2))}
    b = {(t, "adj|adv|n|vblex"): 0.25 for t in ("adj", "adv", "n", "vblex")}
    assert tagger.viterbi_run({"a": a, "b": b}, "sent", [""]) == ["adv"]
    assert tagger.known_class({"a": a, "b": b}, "n|vblex") == "adj|adv|n|vblex"


def test_mixed_training_starts_from_the_mean(spark):
    rows = spark.createDataFrame([("^a/a<n>/a<v>$ ^b/b<n>/b<v>$", "^a/a<n>$ ^b/b<v>$")] * 6, "untagged string, tagged string").repartition(2)
    model = perceptron.train_distributed(rows, perceptron.Templates(perceptron.DEFAULT), rounds=3)
    assert perceptron.tag_text("^a/a<n>/a<v>$ ^b/b<n>/b<v>$", model) == "^a<n>$ ^b<v>$"
