import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitloom.llm import bpe, leak, split
from pitloom.llm.encode import encode_corpus

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def other(enc):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


ODD = ["", " ", "\n \n\n x", "a" * 3000, "ab" * 999, "日本語" * 300, "😀" * 200, "é́ ​<|endoftext|>", "don't we'll 12345 \t!!", "word " * 300]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(enc, other, text):
    assert enc.encode(text) == other.encode_ordinary(text)
    assert enc.count(text) == len(enc.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    e = bpe.encoder(bpe.read_vocabulary())
    assert e.encode(text) == tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={}).encode_ordinary(text)


def test_a_full_memory_is_emptied(other):
    small = bpe.Encoder(bpe.read_vocabulary(), most_words=3)
    text = "one two three four five six seven one two"
    assert small.encode(text) == other.encode_ordinary(text) and len(small.words) <= 3


def test_corpus(spark, other):
    texts = [None, *ODD, "again", "again"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, _text int").repartition(3)
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text", batch_ids=50).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_corpus(df.where("false"), "doc_id", "text").count() == 0
    broken = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", "cast(unhex('61FF62') as string) text")
    assert encode_corpus(broken, "doc_id", "text").first().ids == other.encode_ordinary("a�b")


def test_query_over_documents(spark, base, other):
    from pitloom.llm.queries import p8_ids

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    assert {r.doc_id: r.ids for r in p8_ids(spark, base).collect()} == {i: other.encode_ordinary(t or "") for i, t in texts.items()}


# --- leaks ---------------------------------------------------------------------------------------------------------------

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(3, 8))) for _ in range(400)]
ITEM = " ".join(RND.sample(WORDS, 60))
OTHER = " ".join(RND.sample(WORDS, 60))


@pytest.fixture(scope="module")
def matcher():
    return leak.Matcher([(1, ITEM), (2, OTHER), (3, "too short"), (4, "")])


def passage(n, at=10):
    return ITEM.split()[at : at + n]


@pytest.mark.parametrize("n,case", [(14, True), (13, False), (30, True)])
def test_length_of_a_passage(matcher, n, case):
    got = matcher.passages("some words first " + " ".join(passage(n)) + " and then more")
    assert [r[0] for r in got] == [1] * case


@pytest.mark.parametrize("edits,case", [(1, True), (2, True), (4, False)])
def test_edits(matcher, edits, case):
    for how in ("altered", "left out", "put in"):
        w = passage(24)
        for k in range(edits):
            i = 5 + k * (5 if edits > 2 else 7)
            w[i : i + (how != "put in")] = [] if how == "left out" else ["zzz"]
        got = matcher.passages("x " + " ".join(w) + " y")
        assert bool(got and got[0][0] == 1 and got[0][3] >= 20) == case, how


def test_order_counts(matcher):
    w = passage(30)
    RND.shuffle(w)
    assert matcher.passages(" ".join(w)) == []


FORMS = {
    "case": str.upper, "spacing": lambda t: t.replace(" ", " \t\r\n "), "punctuation": lambda t: "«" + t.replace(" ", ", ") + "!»", "markup": lambda t: "<p>" + t.replace(" ", " <b>") + "</p>",
    "in a word": lambda t: t[:1] + "<b>" + t[1:2] + "</b>" + t[2:], "width": lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t), "unseen": lambda t: "​".join(t),
    "accents": lambda t: t.replace("a", "á").replace("e", "é"), "entities": lambda t: t.replace("a", "&#97;").replace(" ", "&nbsp;"),
}


@pytest.mark.parametrize("form", list(FORMS))
def test_forms_and_offsets(matcher, form):
    told = FORMS[form](" ".join(passage(20)))
    text = "before it, " + told + " after it"
    ((item, begin, end, n, edits),) = matcher.passages(text)
    assert (item, n, edits) == (1, 20, 0)
    assert leak.words(text[begin:end]) == passage(20)
    assert [w for w, _, _ in leak.placed_words(text)] == leak.words(text)


@pytest.mark.parametrize("mark", [f'<a href="{"x y " * 200}">', f'<div style="{"x y " * 200}">', "<!-- one\ntwo three -->", "<!-- " + "long " * 200 + "-->", "<!-- a <!-- b -->"])
def test_long_markup_does_not_count(matcher, mark):
    w = passage(20)
    text = "before " + " ".join([*w[:10], mark, *w[10:]]) + " after --> <!-- open"
    assert [(r[0], r[3], r[4]) for r in matcher.passages(text)] == [(1, 20, 0)]
    assert [x for x, _, _ in leak.placed_words(text)] == leak.words(text)
    told = "two <three " + " ".join(passage(45, 5)) + " and > four"
    assert [r[3] for r in matcher.passages(told)] == [45]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aé <>b/&;#9中ß​́.x")), max_size=40))
def test_placed_words_are_the_words(text):
    assert [w for w, _, _ in leak.placed_words(text)] == leak.words(text)


def test_markup_of_any_length(matcher):
    w = passage(20)
    for mark in ('<a title="' + "x y " * 2500 + '">', "<!-- " + "line\n" * 2000 + "-->", "<details " + "open " * 500 + ">"):
        text = "before " + " ".join([*w[:10], mark, *w[10:]]) + " after"
        assert [(r[0], r[3], r[4]) for r in matcher.passages(text)] == [(1, 20, 0)]


def test_text_between_signs(matcher):
    text = "if a <b " + " ".join(passage(30)) + " c> d"
    ((item, begin, end, n, edits),) = matcher.passages(text)
    assert (item, n, edits) == (1, 30, 0) and leak.words(text[begin:end]) == passage(30)


def test_hangul_words():
    assert len(leak.words("한국 사람은")) == 2
    assert [w for w, _, _ in leak.placed_words("한국 사람은!")] == leak.words("한국 사람은!")


def test_longest_run():
    assert leak.longest_run(14, 10) == 6
    assert leak.longest_run(14, 1000) == 14


def by_hand(items, text, least=14, per_edit=10):
    """Items with a passage, by aligning every beginning in the item with every beginning in the text."""
    w, out = leak.words(text), set()
    for i, t in items:
        x = leak.words(t)
        for k in range(len(x)):
            for j in range(len(w)):
                if x[k] != w[j]:
                    continue
                front = {(k + 1, j + 1): 0}  # (next in the item, next in the text): edits
                for a in range(k + 1, len(x) + 1):
                    for b in range(j + 1, len(w) + 1):
                        e = front.get((a, b))
                        if e is None:
                            continue
                        if a < len(x) and b < len(w) and x[a] == w[b] and a + 1 - k >= least and per_edit * e <= a + 1 - k:
                            out.add(i)
                        for da, db in ((1, 1), (1, 0), (0, 1)):
                            if a + da <= len(x) and b + db <= len(w):
                                cost = e + (0 if da and db and x[a] == w[b] else 1)
                                if cost <= len(x) // per_edit and cost < front.get((a + da, b + db), 99):
                                    front[a + da, b + db] = cost
    return out


def test_no_passage_is_lost():
    rnd = random.Random(5)
    for trial in range(60):
        few = WORDS[: rnd.choice([6, 30, 200])]
        items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.randint(14, 26)))) for i in range(3)]
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.choice([0, 1, 2, 3])):
            k, m, how = rnd.randrange(len(w)), rnd.choice([1, 1, 2]), rnd.randrange(3)
            w[k : k + (m if how else 0)] = [] if how == 1 else [rnd.choice(few) for _ in range(m)]
        text = " ".join([rnd.choice(few) for _ in range(3)] + w + [rnd.choice(few) for _ in range(3)])
        assert {r[0] for r in leak.Matcher(items).passages(text)} == by_hand(items, text), trial


def test_items_with_a_shared_opening():
    opening, rnd = " ".join(WORDS[:12]), random.Random(2)
    items = [(i, opening + " " + " ".join(rnd.choice(WORDS[12:]) for _ in range(60))) for i in range(400)]
    m = leak.Matcher(items)
    text = " ".join(opening + f" zz{k}" for k in range(300))
    began = time.process_time()
    assert m.passages(text) == []
    assert time.process_time() - began < 1  # some 0.1 s
    assert [r[0] for r in m.passages(text + " " + items[7][1] + " " + items[7][1])] == [7]


def test_corpus_of_leaks(spark):
    docs = [(1, ITEM), (2, None), (3, ""), (4, "nothing here"), (5, OTHER + " " + ITEM), (5, OTHER), (6, "x " * 5000 + ITEM)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_id string, words int")
    items = spark.createDataFrame([(1, ITEM, 1), (1, ITEM, 1), (1, "another text of the item", 1), (2, OTHER, 1), (3, None, 1), (None, OTHER, 1)], "item_id long, text string, doc_id int")
    want = [(1, 1), (5, 1), (5, 2), (6, 1)]
    for block in (8_000_000, 500):
        got = leak.leaked_passages(df, "doc_id", "text", items, "item_id", "text", block_chars=block)
        assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == want
    assert leak.leaked_passages(df, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0
    assert leak.leaked_passages(df.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


# --- pieces --------------------------------------------------------------------------------------------------------------


def check(text, enc, limit, overlap):
    pieces = split.split_text(text, enc, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in pieces) == text
    for k, (b, c, e, n) in enumerate(pieces):
        assert n == enc.count(text[b:e]) <= limit
        assert (b == c == 0) if k == 0 else b <= c < e
        torn = max((len(enc.word(w)) for w in enc.find(text)), default=0) > overlap // 2
        assert b == c or enc.count(text[b:c]) <= overlap or torn and enc.count(text[b:c]) <= 2 * overlap  # parts of a cut word count by themselves
    return pieces


@pytest.mark.parametrize("text", ODD)
def test_pieces_of_odd_texts(enc, text):
    for limit, overlap in ((40, 8), (800, 64), (30, 0)):
        check(text, enc, limit, overlap)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n!中é😀")), max_size=400))
def test_pieces_of_any_text(text):
    check(text, bpe.encoder(bpe.read_vocabulary()), 24, 6)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n中é😀🧿")), max_size=120), st.sampled_from([(4, 0), (4, 1), (5, 1), (7, 2)]))
def test_small_limits_end(text, sizes):
    check(text, bpe.encoder(bpe.read_vocabulary()), *sizes)


def test_impossible_limits(enc):
    for limit, overlap in ((3, 0), (2, 0), (40, 20), (40, -1)):
        with pytest.raises(ValueError):
            split.split_text("🧿" * 50, enc, limit, overlap)
    assert split.split_text("", enc) == [(0, 0, 0, 0)]


def test_sentence_ends_behind_many_closers(enc):
    assert split._strength('He left.' + '"' * 20 + " She", 28) == split.SENTENCE
    assert split._strength("(a)" + ")" * 20 + " She", 23) == split.WORD


def test_weak_boundaries_go_first(enc):
    sentence = "The quick brown fox jumps over the lazy dog near the river bank."
    text = "\n\n".join(" ".join([sentence] * 4) for _ in range(6))
    pieces = check(text, enc, 140, 20)
    assert all(text[c - 2 : c] == "\n\n" for _, c, _, _ in pieces[1:])
    assert all(text[b - 1] in ".\n" or text[b].isspace() for b, c, _, _ in pieces[1:])


@pytest.mark.parametrize("gap", ["\n\n", "\n\n ", "\n\n    ", "\n\n\t", "\n          \n", "\r\n\r\n  ", "\n          \n   "])
def test_paragraphs_end_at_any_gap(enc, gap):
    sentence = "The quick brown fox jumps over the lazy dog near the river bank."
    text = gap.join(" ".join([sentence] * 4) for _ in range(6))
    pieces = check(text, enc, 140, 20)
    assert len(pieces) > 2 and all("\n" in text[c - len(gap) : c] and text[c:].lstrip().startswith("The") and text[:c].endswith((gap, gap[:-1])) for _, c, _, _ in pieces[1:])
    assert [split._strength("a." + gap + "b", k) for k in range(1, len(gap) + 3)].count(split.PARAGRAPH) == 1
    assert split.PARAGRAPH not in [split._strength("a.\n  b", k) for k in range(1, 6)]


def test_corpus_of_pieces(spark, enc):
    long = "A few words here. " * 400
    df = spark.createDataFrame([(1, long, 1), (2, "short", 1), (3, None, 1), (4, "", 1), (5, long, 1)], "doc_id long, text string, piece int")
    got = split.split_corpus(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {1, 5}
    assert "".join(long[r.core : r.end] for r in sorted(got, key=lambda r: r.piece_no) if r.doc_id == 1) == long
    assert all(r.piece == long[r.begin : r.end] and r.n_tokens <= 800 for r in got)
    assert split.split_corpus(df.where("false"), "doc_id", "text").count() == 0
