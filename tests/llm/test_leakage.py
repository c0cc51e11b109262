import functools
import random

import pytest

from ionloom.llm import leakage as L

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}ord" for i in range(400)]


def sentence(r, n):
    return [r.choice(WORDS[:300]) for _ in range(n)]


def brute(item, doc, gap=L.GAP):
    """Longest chain of equal runs of three or more words, by trying every run start."""
    runs = []
    for d in range(len(doc)):
        for p in range(len(item)):
            n = 0
            while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n]:
                n += 1
            if n >= L.RUN and not (d and p and item[p - 1] == doc[d - 1]):
                runs.append((d, p, n))
    best = {}
    for d, p, n in sorted(runs):
        prior = [v for (a, b, m), v in best.items() if a + m <= d and b + m <= p and d - a - m <= gap]
        best[(d, p, n)] = n + max(prior, default=0)
    return max(best.values(), default=0)


def test_similar_words():
    assert L.similar("herring", "herrlng") and L.similar("either", "elthcr") is False and L.similar("either", "elther")
    assert not L.similar("cat", "car") and not L.similar("warrant", "pledges")


def test_repeated_words_against_brute_force():
    r = random.Random(0)
    for _ in range(60):
        item = sentence(r, 30)
        doc = sentence(r, 15) + item[3:12] + sentence(r, r.randint(0, 10)) + item[15:15 + r.randint(0, 15)] + sentence(r, 10)
        index = L.ItemIndex([(1, " ".join(item), "")])
        hits = [(d, p) for d in range(len(doc) - 2) for p in range(len(item) - 2) if doc[d : d + 3] == item[p : p + 3]]
        got = L.repeated_words(index.words[0], doc, hits)
        assert got >= brute(item, doc)  # fuzzy growth may add words
        assert got <= brute(item, doc) + 6


def test_wand_finds_exactly_what_scoring_all_finds():
    r = random.Random(1)
    items = [(i, " ".join(sentence(r, 20)), "") for i in range(150)]
    items += [(150 + i, items[i][1], "") for i in range(30)]  # equal passages
    index = L.ItemIndex(items)
    for _ in range(80):
        words = sentence(r, 30) + L.words_of(items[r.randrange(150)][1])[: r.randint(3, 20)]
        code = [index.vocabulary.get(w, 0) for w in words]
        terms = sorted({t for t in range(len(index.terms)) for p in range(len(code) - 2) if index.terms[t] == index._key(code, p)})
        score = {}
        for t in terms:
            for i, x in index.postings[t]:
                score[i] = score.get(i, 0.0) + x
        for threshold in (0.05, 0.2, 0.5):
            want = {i for i, s in score.items() if s >= threshold}
            got = set(index.retrieve(terms, threshold))
            assert {i for i in want ^ got if abs(score.get(i, 0) - threshold) > 1e-9} == set()


SCHEMA = "doc_id long, text string, share string, item_id int"


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash", 9) for i, t in docs], SCHEMA)
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    return {(r.doc_id, r.item_id): r for r in L.find_leaks(d, i, **options).collect()}


def test_cases(spark):
    r = random.Random(7)
    passage = sentence(r, 40)
    item = (5, " ".join(passage).capitalize() + ".", "who must give notice then")
    other = (6, " ".join(sentence(r, 40)), None)
    pad = lambda n: " ".join(sentence(r, n))
    full = " ".join(passage)
    half = " ".join(passage[5:25])
    less = " ".join(passage[5:24])
    noisy = " ".join(w if k % 9 else w[:2] + "x" + w[3:] for k, w in enumerate(passage))
    broken = full.replace(passage[3], passage[3][:3] + "-\n" + passage[3][3:]).upper().replace(" ", ", ", 5)
    split = " ".join(passage[:10]) + " " + pad(12) + " " + " ".join(passage[10:22])
    far = " ".join(passage[:10]) + " " + pad(400) + " " + " ".join(passage[10:22])
    docs = [
        (1, pad(200) + " " + full + " who must give notice then " + pad(100)), (2, half), (3, pad(50) + " " + less), (4, pad(9) + noisy), (5, broken),
        (6, split), (7, far), (8, None), (9, ""), (10, pad(500)), (1, half), (11, pad(20_000) + " " + full), (12, full + " who must give notice then"),
    ]
    got = run(spark, docs, [item, item, other, (7, None, "q"), (8, "two words", "")])
    assert {d for d, _ in got} == {1, 2, 4, 5, 6, 11, 12}
    assert {i for _, i in got} == {5}
    assert got[(11, 5)].share == 1.0 and got[(2, 5)].share == 0.5
    assert got[(12, 5)].question_share == 1.0


def spoilt(r, word):
    k = r.randrange(len(word))
    return word[:k] + r.choice("xyz") + word[k + r.choice([0, 1]) :]


def every_run(item, doc, same=functools.cache(L.similar)):
    """Whether the document leaks the item, from all places where three words in a row are alike."""
    alike = [[same(a, b) for b in doc] for a in item]
    hits = [(d, p) for p in range(len(item) - 2) for d in range(len(doc) - 2) if alike[p][d] and alike[p + 1][d + 1] and alike[p + 2][d + 2]]
    return L.repeated_words(item, doc, hits) >= L.SHARE * len(item)


def test_recall_against_brute_force(spark):
    """Copies with every second, third or any word misspelt, split up, out of order, and half ones."""
    r = random.Random(11)
    lexicon = ["".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(r.randint(4, 11))) for _ in range(400)]
    sentence = lambda r, n: [r.choice(lexicon) for _ in range(n)]
    items = [(i, " ".join(sentence(r, r.randint(12, 40))), "") for i in range(20)]
    docs = []
    for i in range(80):
        w = L.words_of(items[i % 20][1])
        kind = i // 20
        if kind == 0:
            step = r.choice([1, 2, 3])
            w = [spoilt(r, x) if k % step == 0 else x for k, x in enumerate(w)]
        elif kind == 1:
            cut = r.randrange(3, len(w) - 3)
            w = w[:cut] + sentence(r, r.randrange(50)) + w[cut:]
        elif kind == 2:
            cut = r.randrange(3, len(w) - 3)
            w = w[cut:] + w[:cut]
        else:
            w = [spoilt(r, x) if r.random() < 0.3 else x for x in w[: r.randrange(3, len(w))]]
        docs.append((i, " ".join(sentence(r, r.randrange(40)) + w + sentence(r, r.randrange(40)))))
    got = set(run(spark, docs, items))
    words = {i: L.words_of(p) for i, p, _ in items}
    want = {(d, i) for d, t in docs for i in words if every_run(words[i], L.words_of(t))}
    assert len(want) > 45
    assert len(got & want) / len(want) >= 0.99 and got <= want


def test_thresholds_are_lower_bounds():
    r = random.Random(5)
    items = [(i, " ".join(sentence(r, 21)), "") for i in range(30)]
    index = L.ItemIndex(items)
    place = {}
    for t in range(len(index.terms)):
        for k in range(index.place_start[t], index.place_start[t + 1]):
            place[(int(index.place_item[k]), int(index.place_word[k]))] = t
    impact = [dict(p) for p in index.postings]
    for _ in range(200):  # 12 words in four runs of three, or in longer runs
        i = r.randrange(30)
        starts = sorted(r.sample(range(0, 19, 3), 4))
        assert sum(impact[place[(i, s)]][i] for s in starts) >= 1.0
    assert (L.least_triples(3), L.least_triples(4), L.least_triples(6), L.least_triples(7)) == (1, 2, 2, 3)


def test_whole_blocks_are_passed_over():
    # one rare strong item far behind many weak postings
    items = [(i, f"aa{i}x bb cc dd ee ff gg hh", "") for i in range(900)]
    index = L.ItemIndex(items)
    terms = list(range(len(index.terms)))
    common = [t for t in terms if index.post_start[t + 1] - index.post_start[t] == 900]
    got = index.retrieve(common, 0.9 * sum(float(index.term_max[t]) for t in common))
    assert len(got) == 900


def test_blocks_of_items_give_the_same(spark):
    r = random.Random(9)
    items = [(i, " ".join(sentence(r, 25)), "") for i in range(20)]
    docs = [(i, " ".join(sentence(r, 30)) + " " + items[i][1]) for i in range(20)]
    assert set(run(spark, docs, items)) == set(run(spark, docs, items, items_per_pass=6)) == {(i, i) for i in range(20)}


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d", "")]), ([(1, "a b c d")], [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == {}
