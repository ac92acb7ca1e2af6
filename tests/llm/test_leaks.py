import random
import re

from cuefold.llm import leaks as K

DOC, ITEM = "doc_id bigint, text string, ident string, item string", "item_id bigint, text string, lang string"


def words(t):
    return re.findall(r"[a-z0-9]+", t.lower())


def run(spark, docs, items, n=12):
    d = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], DOC)
    i = spark.createDataFrame([(k, t, "en") for k, t in items], ITEM)
    return {(r.item, r.ident): r for r in K.find_leaks(d, i, "doc_id", "text", "item_id", "text", n).collect()}


def brute(docs, items, n):
    out = set()
    for i, t in items:
        own = {tuple(words(t or "")[a : a + n]) for a in range(len(words(t or "")) - n + 1)}
        for d, s in docs:
            w = words(s or "")
            if any(tuple(w[a : a + n]) in own for a in range(len(w) - n + 1)):
                out.add((i, d))
    return out


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "and"] * 8
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60])))) for k in range(30)]
    docs = []
    for k in range(150):
        text = [rng.choice([*vocabulary, *[f"x{j}" for j in range(200)]]) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            own = words(rng.choice(items)[1])
            a, size = rng.randrange(0, len(own)), rng.choice([8, 11, 12, 13, 40])
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = own[a : a + size]
        docs.append((k, " ".join(text)))
    docs += [(900, None), (901, ""), docs[0]]
    for tile in (K.RUN_TILE, 50):
        monkeypatch.setattr(K, "RUN_TILE", tile)
        got = run(spark, docs, items)
        assert {k for k, r in got.items() if r.run_words} == brute(docs, items, 12)


def test_cues_markup_and_lookalikes(spark):
    item = "Every vaulted cistern beside the tannery was surveyed before the petrified almanac could be fumigated again."
    w = item.split()
    srt = "\n\n".join(f"{k + 1}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\n<i>{' '.join(w[3 * k:3 * k + 3])}</i>" for k in range(6))
    odd = item.replace("e", "е").replace("a", "ａ").upper().replace(" ", " ​").replace("VAULTED", "vaul­ted")
    short, broken = " ".join(w[:11]), " ".join([*w[:8], "very", *w[8:]])
    got = run(spark, [(1, srt), (2, odd), (3, short), (4, broken), (5, "x " + item.replace(" ", ", ") + " y")], [(7, item), (8, "too short"), (9, None)])
    assert {d for (i, d), r in got.items() if r.run_words} == {1, 2, 5} and {i for i, _ in got} == {7}
    assert got[(7, 1)].run_words == 16 and got[(7, 4)].run_words == 0 and got[(7, 4)].kept == 1.0


def test_empty(spark):
    assert run(spark, [], [(1, "a " * 20)]) == {}
    assert run(spark, [(1, "a b c " * 20)], []) == {}
    assert set(run(spark, [(1, "a b c " * 20), (1, "a b c " * 20)], [(1, "a b c " * 6)])) == {(1, 1)}


def test_long_document(spark):
    text = "y " * 400_000 + "b c d e f g h i j k l m n " + "z" * 100_000
    assert run(spark, [(1, text)], [(1, "b c d e f g h i j k l m n")])[(1, 1)].run_words == 13


def test_rewording_away_from_the_best_passage(spark):
    """A rewording counts where another passage of a long document has the better cosine."""
    own = [f"w{k}" for k in range(30)]
    # All words in another order are the nearer passage, those in order stand far from it.
    mixed = " ".join(own[:24][::-1])
    fill = " ".join(f"f{k}" for k in range(300))
    reworded = " ".join(w if k % 6 else "other" for k, w in enumerate(own))
    docs = [(1, " ".join([mixed, fill, reworded, fill]))]
    got = run(spark, docs, [(7, " ".join(own)), (8, " ".join(f"v{k}" for k in range(20)))])
    assert got[(7, 1)].run_words == 0 and got[(7, 1)].kept >= 0.8


def test_thinly_spread_rewording(spark):
    """Words of the item in order, but never 12 in 24 words of the document."""
    own = [f"w{k}" for k in range(13)]
    thin = " ".join(f"{w} x{k} y{k}" for k, w in enumerate(own))
    got = run(spark, [(1, "z " * 50 + thin + " z" * 50)], [(7, " ".join(own))])
    assert got[(7, 1)].run_words == 0 and got[(7, 1)].kept == 1.0


def _bank(rng, count):
    vocabulary = [f"w{k}" for k in range(3000)] + [f"c{k}" for k in range(40)] * 20
    return vocabulary, [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(20, 70)))) for k in range(count)]


def test_recall_of_the_cells(spark, monkeypatch):
    """With far more cells than are looked into, verbatim leaks are still found (recall against brute force)."""
    monkeypatch.setattr(K, "CELL_RUNS", 6)
    monkeypatch.setattr(K, "PROBES", 16)
    rng = random.Random(8)
    vocabulary, items = _bank(rng, 400)
    docs = []
    for k in range(300):
        text = rng.choices(vocabulary, k=rng.randrange(40, 200))
        own = words(rng.choice(items)[1])
        a, size = rng.randrange(0, len(own) - 12), rng.choice([12, 14, 20])
        at = rng.randrange(0, len(text) + 1)
        text[at:at] = own[a : a + size]
        docs.append((k, " ".join(text)))
    bank = K.Items.of([(i, t, None) for i, t in items], 12)
    assert len(bank.starts) // K.CELL_RUNS > 8 * K.PROBES
    want = brute(docs, items, 12)
    got = {k for k, r in run(spark, docs, items).items() if r.run_words}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_recall_of_rewordings(spark):
    """Paraphrases that keep four fifths of an item's words in order, with others put in between."""
    rng = random.Random(9)
    vocabulary, items = _bank(rng, 150)
    docs, want = [], set()
    for k in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(40, 200))
        i, t = items[k]
        # Every fifth word is another one, so no run of 12 is left.
        own = [w if n % 5 else rng.choice(["so", "then", "indeed"]) for n, w in enumerate(words(t))]
        at = rng.randrange(0, len(text) + 1)
        text[at:at] = own
        docs.append((k, " ".join(text)))
        want.add((i, k))
    got = {k for k, r in run(spark, docs, items).items() if r.kept >= 0.6}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_answers(spark):
    """An answer counts where it stands near the passage, null where an item has none."""
    own = " ".join(f"w{k}" for k in range(20))
    far = " ".join(f"z{k}" for k in range(200))
    docs = spark.createDataFrame([(1, f"{own} the answer is Ｂlue whale"), (2, f"{own} {far} blue whale"), (3, own)], "doc_id int, text string")
    items = spark.createDataFrame([(7, own, "blue whale"), (8, own, None)], "item_id int, text string, answer string")
    got = {(r.item, r.ident): r.answered for r in K.find_leaks(docs, items, "doc_id", "text", "item_id", "text", item_answer="answer").collect()}
    assert got == {(7, 1): True, (7, 2): False, (7, 3): False, (8, 1): None, (8, 2): None, (8, 3): None}


def test_repeated_word(spark):
    """A run longer than what is compared at a time keeps its length."""
    got = run(spark, [(1, "x " + "a " * 9000 + "y")], [(1, "a " * 5000), (2, "b " * 20)])
    assert {k: r.run_words for k, r in got.items()} == {(1, 1): 5000}


def test_no_candidates(spark):
    """Documents with words of items, but no passage near any; and a run shared with an item that is no candidate."""
    rng = random.Random(4)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(40)]
    docs = [(k, " ".join(rng.choice([f"i{rng.randrange(40)}w{rng.randrange(30)}", "x"]) for _ in range(60))) for k in range(30)]
    assert {k for k, r in run(spark, docs, items).items() if r.run_words} == set()
    bank = K.Items.of([(0, "a b c d e f g h i j k l m n", None), (1, "z y x w v u t s r q p o", None)], 12)
    ids = bank.words(0)
    assert K.shared_runs(ids, bank, bank.grams(), K.np.array([0, 1])) == {0: 14} and K.shared_runs(ids, bank, bank.grams(), K.np.array([1])) == {}
