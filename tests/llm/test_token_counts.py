import random

from plotline.llm import packing, token_counts


def greedy(pieces, word):
    """Longest match from the left, piece by piece; None if it gets stuck."""
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(8)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        a = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", weights=[5, 5, 5, 1], k=rng.randint(0, 14)))
            want = greedy(pieces, word)
            assert a.count(word) == (1 if want is None else want), (pieces, word)


def test_rows_of_the_table_against_greedy_matching(spark):
    spec = open(packing.default_tokenizer_path(), "rb").read()
    pieces = set(token_counts.vocabulary(spec))
    assert len(pieces) == 50_256 and all(bytes([b]) in pieces for b in range(256))
    longest = max(map(len, pieces))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    for r in docs.collect():
        words, total = r.text.encode().split(), 0
        for w in words:
            w, at = b" " + w, 0
            while at < len(w):
                at = next(e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in pieces)
                total += 1
        assert got[r.doc_id] == (len(words), total)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "the the"), (4, "the the"), (None, "x" * 200_000), (5, "漢字 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert [g for g in got if g[0] == 4] == [(4, 2, 2)] * 2
    assert len(got) == 7
    assert token_counts.count_tokens(docs.filter("false")).count() == 0
