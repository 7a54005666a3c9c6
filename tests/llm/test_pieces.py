import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import pieces
from logsift.llm.common import table

from .conftest import ODD

PIECES = pieces.load_pieces()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeiounstrh ▁é\n\t!漢🙂Ab0129.­", max_size=60))
def test_words_fold_to_the_library_s_ids(text):
    ids = [i for w in pieces.words_of(text) for i in pieces.fold_word(w, PIECES)]
    assert ids == LIBRARY.encode(text)
    assert pieces.decode_ids(ids, PIECES) == LIBRARY.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("table_words", [0, 50, 1 << 18])
def test_texts(spark, odd, small, table_words):
    """The same ids whether words come from the broadcast table or are folded in place."""
    for docs, rows in ((odd, [r[:2] for r in ODD]),
                       (table(spark, small, "documents"), [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()])):
        got = pieces.encode_texts(docs, table_words=table_words).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(((d, LIBRARY.encode(t or "")) for d, t in rows), key=key)
        assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aeinrsthlou .,▁é漢🙂", min_size=1, max_size=20), min_size=1, max_size=30))
def test_many_words_fold_like_each(texts):
    words, joins = sorted({w for t in texts for w in pieces.words_of(t)}), pieces.Joins(PIECES)
    flat, sizes = pieces.fold_words(words, PIECES, joins) if words else (None, [])
    ends = [sum(sizes[:i + 1]) for i in range(len(words))]
    each = [pieces.fold_word(w, PIECES) for w in words]
    assert [flat[e - n:e].tolist() for n, e in zip(sizes, ends)] == each
    assert [pieces.fold_long(w, PIECES, joins).tolist() for w in words] == each


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n▁é\t漢🙂\x00", max_size=25)), max_size=8))
def test_texts_split_like_each(texts):
    code, names, count = pieces.split_words(texts)
    assert [names[i] for i in code] == [w for t in texts for w in pieces.words_of(t)]
    assert count.tolist() == [len(pieces.words_of(t)) for t in texts]


def test_a_text_of_two_million_characters_without_a_space():
    import random
    import time
    rng = random.Random(1)
    word = "".join(rng.choices("abcdehinrst1漢", k=2_000_000))
    began = time.process_time()
    ids = pieces.fold_long(word, PIECES, pieces.Joins(PIECES))
    assert time.process_time() - began < 30 and pieces.decode_ids(ids.tolist(), PIECES, False) == word
    part = word[:20_000]
    assert pieces.fold_long(pieces.SPACE + part, PIECES, pieces.Joins(PIECES)).tolist() == LIBRARY.encode(part)


def test_tasks_forget_words_but_not_ids(spark, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 20)
    store = pieces.WordIds(PIECES, [" the"], LIBRARY.encode("the"), [1], False)
    for text in ("the quick brown fox", "漢字 " + "long" * 40, "a b c d e f g h i j k l m n o p q r s t u v w", "the quick end"):
        flat, sizes, good = store.encode([text, None])
        assert flat.tolist() == LIBRARY.encode(text) and sizes.tolist() == [len(flat), 0] and good.all()


def best_by_all_paths(word):
    word, floor = word.replace(" ", pieces.SPACE), min(PIECES.scores.values()) - 10

    def best(s):
        if s == len(word):
            return 0.0
        out = []
        for e in range(s + 1, len(word) + 1):
            score = PIECES.scores.get(word[s:e], floor if e == s + 1 else None)
            if score is not None:
                out.append(score + best(e))
        return max(out)

    return best(0)


@pytest.mark.parametrize("viterbi", [False, True])
def test_relational_lattice(spark, small, viterbi):
    words = sorted({w for r in table(spark, small, "documents").limit(30).collect() for w in pieces.words_of(r.text)})
    got = {r.word: list(r.ids) for r in pieces.lattice_ids(spark.createDataFrame([(w,) for w in words], "word string"), PIECES, viterbi).collect()}
    assert len(got) > 0.95 * len(words)
    assert all(ids == pieces.fold_word(w, PIECES, viterbi) for w, ids in got.items())
    if viterbi:
        for w in [w for w in got if len(w) <= 9][:40]:
            assert abs(sum(LIBRARY.get_score(i) for i in got[w]) - best_by_all_paths(w)) < 1e-6


def test_decoding(spark, small):
    docs = table(spark, small, "documents")
    back = pieces.decode_texts(pieces.encode_texts(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_empty(empty):
    assert pieces.encode_texts(empty).count() == 0


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 5), ("e", 1), ("x" * 61, 99)], "word string, n long")
    pick = lambda n: {r.word for r in pieces.frequent_words(counts, n).collect()}
    assert pick(0) == set() and pick(3) == {"a"} and pick(4) == {"a", "b", "c", "d"} and pick(9) == {"a", "b", "c", "d", "e"}
