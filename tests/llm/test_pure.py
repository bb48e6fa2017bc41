"""Parts that run without Spark: coders, grammars, models."""

import json
import math
import re
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswork.llm import chat, decontam, media, quality, rans, sharding, simhash, toxicity

TEXTS = st.text(st.characters(exclude_categories=["Cs"]), max_size=300)


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_blocks_decode_to_what_they_were_made_of(ids, seed):
    ids = np.array(ids, np.uint32)
    table = rans.Table.of(np.bincount(ids, minlength=400) + (np.arange(400) % seed == 0))
    data = rans.encode_block(ids, table)
    assert rans.decode_block(memoryview(data), 0, table).tolist() == ids.tolist()
    assert rans.decode_block(memoryview(data), 0, table, len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 : len(ids) // 2].tolist()


def test_files_keep_documents_and_notice_damage():
    ids = np.random.default_rng(1).integers(0, 50, 700_000).astype(np.uint32)
    lengths = np.array([0, 1, 699_000, 999], np.uint32)
    table = rans.Table.of(np.bincount(ids, minlength=60))
    data = rans.encode_file(np.array([1, 2, 0, 9]), np.array([1, 1, 0, 1]), lengths, ids, table)
    doc_ids, has_id, sizes, back = rans.decode_file(data, table)
    assert (back == ids).all() and sizes.tolist() == lengths.tolist() and has_id.tolist() == [1, 1, 0, 1] and doc_ids.tolist() == [1, 2, 0, 9]
    assert len(data) < 700_000  # log2(50) bits an id
    for a, b in ((0, 1), (rans.BLOCK - 3, rans.BLOCK + 5), (699_990, 700_000), (300_000, 650_000), (7, 7)):
        assert rans.decode_ids(data, table, a, b).tolist() == ids[a:b].tolist()
    for at in (len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode_file(bytes(broken), table)


def test_tables_of_odd_counts():
    for counts in ([0, 0, 0], [1], [10**12, 1, 0, 1], list(range(70_000))):
        table = rans.Table.of(np.array(counts, np.int64))
        assert int(table.freq.sum()) == 1 << table.bits
        assert all(table.freq[i] > 0 for i, c in enumerate(counts[:100]) if c)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@given(st.lists(TEXTS, max_size=4))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_the_tokenizer(name, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(name)
    texts = [*texts, None, "", "don't <|endoftext|> Émile's été, \x1c\x85 İ ΑΣ", " Ünder-'LL!'s  x1 ", "".join(map(chr, range(1, 0x250)))]
    ids, counts = rans.encoder(path).encode(pa.array(texts, pa.string()), 1)
    expected = [_whole(path).encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == [i for e in expected for i in e] and counts.tolist() == [len(e) for e in expected]


@cache
def _whole(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_only_the_expected_settings_are_taken_by_runs(tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert rans.TextEncoder(path).by_runs and not rans.TextEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_runs
    settings_ = json.loads(Path(path).read_text())
    settings_["normalizer"]["normalizers"].pop()  # nothing is lower-cased any more
    other = tmp_path / "other.json"
    other.write_text(json.dumps(settings_))
    coder = rans.TextEncoder(str(other))
    text = "Some Words, and MORE of them"
    assert not coder.by_runs
    assert coder.encode(pa.array([text]), 1)[0].tolist() == [*_whole(str(other)).encode(text, add_special_tokens=False).ids, 1]


def test_ids_are_the_same_after_the_cache_is_emptied(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"common words and word{k} or été{k % 7}, once{k * k} \u0153uvre{k}" for k in range(300)]
    expected = [x.tolist() for x in rans.TextEncoder(path).encode(pa.array(texts), 1)]
    monkeypatch.setattr(rans, "CACHED", 40)
    small, ids, counts = rans.TextEncoder(path), [], []
    for a, b in rans._chunks(pa.array(texts), 300):
        got = small.encode(pa.array(texts[a:b]), 1)
        ids, counts = ids + got[0].tolist(), counts + got[1].tolist()
    assert [ids, counts] == expected and len(small.place) <= 40 + 60


TURN_TEXTS = st.one_of(TEXTS, st.lists(st.sampled_from([*chat.CONTROLS, "\\", " ", "ok", "\n", "[INST", "/INST]"]), max_size=8).map("".join))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE] x"]), TURN_TEXTS), max_size=6))
@settings(max_examples=300, deadline=None)
def test_conversations_come_back(turns):
    line, spans = chat.format_turns(turns)
    assert chat.parse(line) == turns
    assert [chat.unescape(line[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_text_is_escaped():
    line, _ = chat.format_turns([("user", "plain"), ("assistant", "</s>[INST] ok [/INST]")])
    assert line == "<s>[INST] plain [/INST] \\</s>\\[INST] ok \\[/INST] </s>"
    for bad in ("<s>[INST] open", "text", "<s>[INST] a </s>", "[SYS] a [/INST]"):
        with pytest.raises(chat.ParseError):
            chat.parse(bad)


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_payloads_are_stored_losslessly(text):
    payload = media.payload_of(text)
    assert len(payload) % media.WIDTH == 0 and payload and payload.startswith(text.encode()) and set(payload[len(text.encode()) :]) <= {255}
    assert media.from_png(media.to_png(payload)) == payload
    assert media.feature_of(payload) == media.feature_of(media.payload_of(text))


def test_payload_edges():
    assert media.payload_of(None) == media.payload_of("") == b"\xff" * 576
    assert len(media.payload_of("a" * 576)) == 576 and len(media.payload_of("a" * 577)) == 1152
    broken = bytearray(media.to_png(b"a" * 576))
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_sequences_keep_order_and_captions():
    html = '<h1>T</h1><p>a <b>b</b><figure><img src="sha256:%s" alt="x"><figcaption>cap &amp; tion</figcaption></figure>c<script>no</script><img src="u" alt="two"></p>' % ("0" * 64)
    found = media.sequence_of(html)
    assert [(e["pos"], e["kind"], e["text"] or e["src"], e["caption"]) for e in found] == [(0, "text", "T", None), (1, "text", "a b", None), (2, "media", "sha256:" + "0" * 64, "cap & tion"), (3, "text", "c", None), (4, "media", "u", "two")]
    assert found[2]["digest"] == "0" * 64 and found[4]["digest"] is None
    assert media.sequence_of(None) == [] and media.sequence_of("<p></p>") == []


def test_majority_bits_against_a_plain_count():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 255, 256, 600, 0, 3])
    hashes = rng.integers(0, 2**64, int(counts.sum()), dtype=np.uint64)
    got, at = simhash.majority_bits(hashes, counts), 0
    for n, fp in zip(counts, got):
        own = [int(h) for h in hashes[at : at + n]]
        at += n
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_shingles_of_short_texts():
    assert simhash.shingle_hashes(None) == simhash.shingle_hashes(" \t\n") == []
    assert len(simhash.shingle_hashes("One two")) == 1 == len(simhash.shingle_hashes("a b c")) and len(simhash.shingle_hashes("a b c d")) == 2
    assert simhash.shingle_hashes("A B C") == simhash.shingle_hashes("a  b\nc") != simhash.shingle_hashes("a b\xa0c")


def test_grants_keep_limits():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 6))
        loads = [int(x) for x in rng.integers(0, 50, n)]
        limits = [x + int(rng.integers(0, 10)) for x in loads]
        wishes = {(i, j): int(rng.integers(0, loads[i] // (n - 1) + 1)) for i in range(n) for j in range(n) if i != j}
        granted = sharding.grant(wishes, loads, limits)
        after = [loads[s] + sum(v for (_, t), v in granted.items() if t == s) - sum(v for (f, _), v in granted.items() if f == s) for s in range(n)]
        assert all(0 <= granted[k] <= wishes[k] for k in wishes) and all(a <= b for a, b in zip(after, limits))
    assert sharding.quotas(35, 16) and sum(sharding.quotas(35, 16)) == 35 and max(sharding.quotas(35, 16)) - min(sharding.quotas(35, 16)) <= 1
    assert sharding.quotas(0, 16) == [0] * 16


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.85, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(20_000) < 0.3, 0, np.where((rng.random(20_000) < r) == truth, 2, 1)) for r in right], axis=1)
    codes = (votes * 3 ** np.arange(8, -1, -1)).sum(axis=1)
    patterns, counts = np.unique(codes, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert abs(model.share - 0.8) < 0.03
    posterior = dict(zip(patterns.tolist(), model.posterior(patterns)))
    assert np.mean([(posterior[c] >= 0.5) == t for c, t in zip(codes.tolist(), truth)]) > 0.95


def test_the_most_frequent_word_may_start_late_in_a_run():
    values = quality.statistics(" ".join([f"w{k}" for k in range(40)] + ["again"] * 160))[0]
    assert values[quality.STATISTICS.index("top_word")] == 0.8
    assert next(l for l in quality.LABELLERS if l.name == "no word rules").vote(values) == 0


def test_quality_of_plain_and_junk():
    assert quality.statistics(None) is None and quality.statistics(" \n") is None
    assert quality.pattern_of(None) == 0
    clean = quality.statistics("The house stood on a hill. It had seen many winters, and more than one war.")[0]
    junk = quality.statistics("BUY!! NOW!! ### $$$ " * 40)[0]
    assert sum(l.vote(clean) == 1 for l in quality.LABELLERS) > 6 and sum(l.vote(junk) == 0 for l in quality.LABELLERS) > 3


def test_evidence_is_length_normalised():
    model = toxicity.Model({b"scum": 3.0}, {b"you": 0.0}, {(b"you", b"scum"): 1.0}, 0.0, 2.0, -3.0)
    assert model.evidence("You scum!") == 2.0 and math.isclose(model.evidence("scum " + "word " * 9), 0.3)
    assert model.evidence(None) == model.evidence("") == model.evidence("...") == 0.0
    assert model.score(np.array([0.0]))[0] < 0.5 < model.score(np.array([2.0]))[0] <= 1


def test_toxicity_holds_little_of_many_different_words():
    import random
    import tracemalloc

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=8))
    texts = [" ".join(word() for _ in range(200)) + " zülpe vorka" for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 for k in range(200)])], names=["text", "toxic"])
    once, counted = {}, 0
    tracemalloc.start()
    try:
        for out in toxicity._counts(iter([batch])):
            counted += sum(out.column(2).to_pylist()) + sum(out.column(3).to_pylist())
            for v, w, n in zip(*(out.column(k).to_pylist() for k in (0, 1, 2))):
                if w in (b"vorka", "zül*".encode()):
                    once[v, w] = once.get((v, w), 0) + n
            del out
        most = tracemalloc.get_traced_memory()[1]
        # nothing is left out: each word by itself and after the one before it, and all its beginnings
        assert once == {(None, b"vorka"): 100, ("zülpe".encode(), b"vorka"): 100, (None, "zül*".encode()): 100}
        assert counted == 200 * (202 * 2 + 200 * 6 + 3 + 3)
        model = toxicity.Model({b"vorka": 2.0}, {}, {}, 0.0, 1.0, 0.0, {t.split()[0][:3].encode() + b"*": 1.0 for t in texts} | {"zül*".encode(): 0.5})
        tracemalloc.reset_peak()
        for t in texts:
            expected = math.fsum(model.alone(w) for w in toxicity.words_of(t)) / 202
            assert math.isclose(model.evidence(t), expected, rel_tol=1e-12) and expected > 0
        assert max(most, tracemalloc.get_traced_memory()[1]) < 60e6
    finally:
        tracemalloc.stop()
    assert len(model.seen) < 10_000


def test_wand_equals_exhaustive_scores():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for i in range(300)]
    index = decontam.Index(items, 64)
    for _ in range(60):
        terms = sorted({int(t) for t in rng.integers(0, len(index.terms), int(rng.integers(1, 50)))})
        scores = np.zeros(len(index.items))
        for t in terms:
            scores[index.of[index.starts[t] : index.starts[t + 1]]] += index.impact[index.starts[t] : index.starts[t + 1]]
        assert {j for j, _ in index.search(terms)} == {j for j, s in enumerate(scores) if s >= 1 - 1e-9}
        window = np.zeros(len(terms), np.int64)
        if (scores >= 1 + 1e-6).any():
            assert index.candidates(np.array(terms), window).tolist() == [0]


def test_decontamination_against_brute_force():
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(3, 50)))) + ". " + " ".join(rng.choice(words, 4)) + ".") for i in range(40)]
    texts = []
    for k in range(120):
        own = list(rng.choice(words, int(rng.integers(0, 500))))
        if k % 3:
            copy = items[k % 40][1].split()
            if k % 3 == 2:
                copy[len(copy) // 2] = "changed"
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = copy
        texts.append(" ".join(own))
    texts += [None, "", "v1"]
    index, known = decontam.Index(items, 64), 0
    for text, found in zip(texts, index.matches(texts)):
        expected = {i for i, item in items if holds(text, item, 128)}
        assert {m[0] for m in found} == expected
        known += len(expected)
    assert known > 50


def plain_words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def holds(text, item, span):
    """Whether some span that begins with a shingle of the item has 0.8 of them, and half of the words of either part."""
    own, wanted = plain_words(text), plain_words(item)
    k = min(5, len(wanted))
    shingles = [wanted[x : x + k] for x in range(len(wanted) - k + 1)]
    sentences = re.findall(r"[^.?!]+[.?!]?", item)
    parts = [plain_words(" ".join(sentences[:-1])), plain_words(sentences[-1])] if len(sentences) > 1 else [wanted]
    for x in range(len(own)):
        if own[x : x + k] in shingles:
            held = own[x : x + span]
            runs = [held[y : y + k] for y in range(len(held) - k + 1)]
            if sum(s in runs for s in shingles) >= 0.8 * len(shingles) and all(sum(min(p.count(w), held.count(w)) for w in set(p)) >= 0.5 * len(p) for p in parts):
                return True
    return False


def test_a_question_without_its_answer_is_no_leak():
    question, answer = "Which of the rivers runs all the way through the old town past the mill and the bridge to the sea?", "The slow green one."
    index = decontam.Index([(1, f"{question} {answer}")], 64)
    found = index.matches([f"x {question} {answer} y", f"x {question} Nobody could say. y", f"x {answer} y", f"{question} The slow one."])
    assert [[m[0] for m in own] for own in found] == [[1], [], [], [1]]
    assert found[0][0][2:] == (1.0, 1.0, 1.0) and found[3][0][4] == 0.75


@pytest.mark.parametrize("size", [59, 64])
def test_an_edited_copy_is_found_at_every_offset(size):
    item = [f"i{k}" for k in range(size)]
    index = decontam.Index([(7, " ".join(item))], 64)
    for insertion in (1, 30, 54):
        copy = item[:insertion] + [f"n{k}" for k in range(20)] + item[insertion:]
        texts = [" ".join([f"a{k}" for k in range(at)] + copy + [f"z{k}" for k in range(250 - at)]) for at in range(251)]
        assert {tuple(m[0] for m in found) for found in index.matches(texts)} == {(7,)}
        assert len({m for found in index.matches(texts) for m in found}) == 1
    # spread over more than twice the longest item's length, it is held nowhere
    far = [" ".join([f"a{k}" for k in range(at)] + item[:30] + [f"n{k}" for k in range(130)] + item[30:] + ["z"] * (250 - at)) for at in range(251)]
    assert index.matches(far) == [[]] * 251


def test_question_and_answer():
    assert decontam.question_and_answer("What is it? A hill. A house.") == ("What is it? A hill. ", "A house.")
    assert decontam.question_and_answer("One sentence") == ("One sentence", "")
    assert decontam.Index([(1, None), (2, "...")], 64).matches(["a b"]) == [[]]

