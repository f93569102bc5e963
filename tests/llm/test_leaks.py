import random

from labelloom.llm import leaks

WORDS = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 12


def text(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leaks.words(t)] for i in range(len(w) - n + 1)}
    own = [(i, grams(t)) for i, t in items if i is not None]
    return {(d, i) for d, t in docs for i, g in own if g & grams(t)}


def test_random_against_brute_force(spark):
    pick = random.Random(9)
    items = [(i, text(pick, pick.randrange(3, 30))) for i in range(30)] + [(90, None), (91, ""), (None, text(pick, 20))]
    docs = []
    for d in range(150):
        body = leaks.words(text(pick, pick.randrange(0, 60)))
        if pick.random() < 0.5:
            w = leaks.words(pick.choice(items[:30])[1])
            at = pick.randrange(len(w))
            body[len(body) // 2 : len(body) // 2] = w[at : at + pick.randrange(3, 14)]
        docs.append((d, pick.choice(["-", " ", ", ", "\n"]).join(x.upper() if pick.random() < 0.3 else x for x in body)))
    docs += [(500, None), (501, ""), docs[0], (0, text(pick, 30)), (502, docs[5][1] + " " + "z " * 20_000)]
    for n in (4, 6):
        got = leaks.shared_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), length=n, block_items=7)  # several blocks
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items, n)


def test_shards_keep_documents_whole(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(50)], "doc_id bigint, text string")
    index = leaks.build_index(docs, "doc_id", "text", shard_words=20)
    assert index.count() > 5
    assert index.selectExpr("sum(size(positions)) n").first().n == 400
    assert leaks.term_counts(index) == dict.fromkeys("abcdefgh", 50)
    assert leaks.term_counts(leaks.build_index(docs, "doc_id", "text", {"c", "x"})) == {"c": 50}


def test_large_vocabularies_store_every_term(spark, monkeypatch):
    monkeypatch.setattr(leaks, "VOCABULARY", 3)
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c"), (3, "b c d e")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c d e")], "item_id bigint, text string")
    assert leaks.vocabulary_of(items, "text") is None
    assert sorted(tuple(r) for r in leaks.shared_passages(docs, items, length=4).collect()) == [(1, 7), (3, 7)]


def brute_near(docs, items, share, span):
    held = {w for _, t in docs for w in leaks.words(t)}
    out = {}
    for i, t in items:
        item = leaks.words(t)
        terms = set(item) & held
        need, width = -(-share * len(terms) // 1), max(span, 5 * len(item) // 4)
        for d, body in docs:
            w = leaks.words(body)
            most = max((len(terms & set(w[k : k + width])) for k in range(len(w))), default=0)
            if need and most >= need:
                out[d, i] = max(most, out.get((d, i), 0))
    return out


def test_near_against_brute_force(spark):
    pick = random.Random(4)
    items = [(i, text(pick, pick.randrange(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "zz yy")]
    docs = []
    for d in range(120):
        body = leaks.words(text(pick, pick.randrange(0, 80)))
        if pick.random() < 0.6:
            w = [x for x in leaks.words(pick.choice(items[:25])[1]) if pick.random() < 0.85]
            pick.shuffle(w) if pick.random() < 0.3 else None
            body[len(body) // 2 : len(body) // 2] = w
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), docs[0], (0, text(pick, 30)), (502, "z " * 20_000 + (docs[5][1] or ""))]
    for share, span in ((0.75, 10), (0.5, 4), (1.0, 30)):
        got = leaks.near_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), share=share, span=span, block_items=9).collect()
        assert {(r.doc_id, r.item_id): r.n_terms for r in got} == brute_near(docs, items, share, span)


def test_near_long_short_and_absent(spark):
    long = [f"u{i // 50}" if i % 50 == 0 else f"c{i % 7}" for i in range(600)]
    altered = " ".join(w for i, w in enumerate(long) if i % 25 != 5)
    kept = [f"k{i}" for i in range(20)]
    docs = [(1, "x y " + " ".join(long) + " z"), (2, altered), (3, " ".join(w + " y" * 400 for w in long[::50])), (4, " ".join(kept[:16])), (5, "a b c"), (6, "a b"), (7, "k16 k17 k18 k19")]
    items = [(1, " ".join(long)), (2, "not1 not2 not3 not4 " + " ".join(kept)), (3, "a b c"), (4, "nothing of this is held")]
    got = leaks.near_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_terms) for r in got) == [(1, 1, 19), (2, 1, 19), (4, 2, 16), (5, 3, 3)]


def test_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")
    assert leaks.shared_passages(docs, items).count() == 0
    assert leaks.shared_passages(docs, items.limit(0)).count() == 0
    assert leaks.near_passages(docs, items.limit(0)).count() == 0
