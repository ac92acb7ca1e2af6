import random

from pyspark.sql import functions as F

from cuefold.llm import language as G

SF = "/root/testdata/sf0.01"
EN = ["Nobody believes what the captain wrote about the letter", "The old keeper lost the medicine in the harbour", "She told the driver that the lantern was returned"]
FR = ["Je ne sais pas", "Où est la clé ?", "Il est parti", "Avec ma soeur", "Le boulanger", "C'est pour vous"]


def lines(spark):
    labels = spark.read.parquet(f"{SF}/track.parquet").select("file", "track_id", G.language_of_code(F.col("language_code")).alias("label")).distinct()
    return spark.read.parquet(f"{SF}/ocr_result.parquet").where("text is not null").join(labels, ["file", "track_id"]).select("file", "text", "label")


def shares(df, profiles, keys=("file",), least=0.2):
    counts = G.count_languages(df, list(keys), "ocr_id", "text", profiles)
    return {(r.file, r.language): (r.units, round(r.share, 3)) for r in G.language_shares(counts, list(keys), profiles, least).collect()}


def test_held_out_accuracy(spark):
    """Fitted on half of the titles, the profiles name the language of texts of other titles."""
    held = F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    data = lines(spark)
    profiles = G.fit_profiles(data.where(~held), "text", "label", 2000)
    assert profiles.languages == sorted(G.CODES)
    rows = data.where(held & F.col("label").isNotNull() & (F.length("text") > 20)).collect()
    found, lead = G.classify([r.text for r in rows], profiles)
    said = [profiles.names[k] if k >= 0 else None for k in found]
    # About a tenth of the labels are wrong on purpose.
    agree = sum(a == r.label for a, r in zip(said, rows, strict=True)) / len(rows)
    assert agree > 0.85 and sum(x is None for x in said) < 0.01 * len(rows) and said.count(G.OTHER) < 0.05 * len(rows)
    clean = {
        "eng": "Nobody believes what the captain wrote about the letter", "fre": "Je ne sais pas où le boulanger a mis la lanterne", "ger": "Ich weiß nicht, wohin der Bäcker die Geige gelegt hat",
        "spa": "No sé dónde puso mi hermana el libro de cuentas", "ita": "Non so dove il nostro vicino abbia messo la valigia", "dut": "Niemand gelooft wat de chauffeur heeft geschreven",
    }
    k, c = G.classify(list(clean.values()), profiles)
    assert [profiles.languages[x] for x in k] == list(clean) and (c > 0.1).all()


def test_held_out_segments(spark):
    """Texts put together from lines of titles the profiles never saw: lines end up in segments of their language."""
    held = F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    data = lines(spark)
    profiles = G.fit_profiles(data.where(~held), "text", "label", 3000)
    pool = {}
    for r in data.where(held & F.col("label").isNotNull()).orderBy("text").collect():
        k, lead = G.classify([r.text], profiles)
        # Labels are wrong on purpose in places; a text counts where label and a clear lead agree.
        if 0 <= k[0] < 6 and profiles.languages[k[0]] == r.label and lead[0] > 0.3:
            pool.setdefault(r.label, set()).update(x for x in r.text.split("\n") if len(x) > 25)
    rng, texts, want = random.Random(2), [], {}
    for i in range(150):
        parts = [(lang, rng.choice(sorted(pool[lang]))) for lang in rng.choices(sorted(pool), k=3) for _ in range(rng.randrange(1, 4))]
        texts.append((i, "\n".join(t for _, t in parts)))
        want |= {(i, n): lang for n, (lang, _) in enumerate(parts)}
    df = spark.createDataFrame(texts, "id int, text string")
    got = {(r.id, n): r.language for r in G.segment_languages(df, ["id"], "text", profiles).collect() for n in range(r.first, r.last + 1)}
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) > 0.95 * len(want)


def test_segments_and_edges(spark):
    profiles = G.fit_profiles(lines(spark), "text", "label", 3000)
    text = "Nobody believes what the captain wrote.\nThe old keeper lost the medicine.\nJe ne sais pas où le boulanger a mis la lanterne.\n42\nNon so dove il vicino abbia messo la valigia."
    rows = [(1, text, "x"), (2, None, "x"), (3, " \n", "x"), (4, "42", "x"), (5, text.upper().replace("A", "Ａ"), "x"), (1, text, "x"), (6, "17\n" + text, "x")]
    df = spark.createDataFrame(rows, "id int, text string, segment string")
    got = G.segment_languages(df, ["id"], "text", profiles).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add((r.segment, r.language, r.first, r.last, r.units, r.decided))
    assert by[1] == {(0, "eng", 0, 1, 2, 2), (1, "fre", 2, 3, 2, 1), (2, "ita", 4, 4, 1, 1)} == by[5]
    assert by[6] == {(0, "eng", 0, 2, 3, 2), (1, "fre", 3, 4, 2, 1), (2, "ita", 5, 5, 1, 1)}
    assert by.keys() == {1, 4, 5, 6} and by[4] == {(0, None, 0, 0, 1, 0)} and len(got) == 13
    assert all(0 <= r.confidence <= 1 for r in got)
    assert G.segment_languages(df.limit(0), ["id"], "text", profiles).count() == 0
    mixed = "Je ne sais pas où le boulanger a mis la valise. Nessuno crede a quello che il fornaio ha scritto. \n\n1\n00:01 --> 00:02\nThe driver returned the lantern last night."
    d = spark.createDataFrame([(1, mixed)], "id int, text string")
    assert [r.language for r in G.segment_languages(d, ["id"], "text", profiles, "sentence").orderBy("segment").collect()] == ["fre", "ita", "eng"]
    long = spark.createDataFrame([(1, " ".join(EN * 5000))], "id int, text string")
    assert [(r.language, r.units) for r in G.segment_languages(long, ["id"], "text", profiles).collect()] == [("eng", 1)]


def test_cases(spark):
    found = spark.createDataFrame([("f", 1, "eng"), ("f", 1, "fre"), ("f", 2, "ger"), ("f", 3, "spa"), ("f", 4, "dut")], "file string, track_id int, language string")
    tracks = spark.createDataFrame([("f", 1, "eng", 0), ("f", 2, "DEU", 0), ("f", 2, "DEU", 0), ("f", 3, "und", 0), ("f", 4, "fr-CA", 0), ("f", 5, None, 0), ("f", 6, " ", 0)], "file string, track_id int, language_code string, language int")
    got = {(r.track_id, r.language) for r in G.label_cases(tracks, ["file", "track_id"], "language_code", found).collect()}
    assert got == {(1, "eng"), (1, "fre"), (3, "spa"), (4, "dut")}


def test_evidence_of_a_group(spark):
    """Distances of all lines of a language decide: near the main language it is misread, clearly off it is a second one."""
    profiles = G.Profiles(["eng", "ita", "spa"], G.np.zeros(1, G.np.uint64), G.np.zeros((3, 1), G.np.int32))
    schema = "file string, language int, units long, chars long, sure double, missing double, d0 double, d1 double, d2 double"
    rows = [
        ("misread", 2, 7, 70, 35.0, 0.0, 9e4, 6e4, 3e4), ("misread", 1, 3, 30, 3.0, 0.0, 9e3, 8.8e3, 9e3),
        ("second", 2, 7, 70, 35.0, 0.0, 9e4, 6e4, 3e4), ("second", 1, 3, 30, 12.0, 0.0, 9e3, 3e3, 9e3),
        ("few", 2, 4, 40, 20.0, 0.0, 9e4, 6e4, 3e4), ("few", 1, 1, 4, 2.0, 0.0, 9e2, 2e2, 9e2),
        ("other", 2, 5, 70, 35.0, 0.0, 9e4, 6e4, 3e4), ("other", 3, 5, 70, 9.0, 40.0, 9e4, 9e4, 8e4),
        ("only", 3, 5, 70, 9.0, 40.0, 9e4, 9e4, 8e4), ("short", 1, 1, 9, 1.0, 0.0, 9e2, 8e2, 9e2),
    ]
    counts = spark.createDataFrame(rows, schema)
    got = {(r.file, r.language): (r.units, r.share) for r in G.language_shares(counts, ["file"], profiles, 0.2).collect()}
    assert got == {
        ("misread", "spa"): (10, 1.0), ("second", "spa"): (7, 0.7), ("second", "ita"): (3, 0.3), ("few", "spa"): (5, 1.0),
        ("other", "spa"): (5, 0.5), ("other", "other"): (5, 0.5), ("only", "other"): (5, 1.0), ("short", "ita"): (1, 1.0),
    }


def test_no_labels(spark):
    empty = spark.createDataFrame([], "text string, label string")
    profiles = G.fit_profiles(empty, "text", "label")
    df = spark.createDataFrame([("f", 1, "some words")], "file string, ocr_id int, text string")
    assert [r.language for r in G.segment_languages(df, ["ocr_id"], "text", profiles).collect()] == [None]
    assert shares(df, profiles) == {}


def test_short_lines_back_their_language_together(spark):
    """A second language that fills a third of a track with lines under 20 characters belongs to it; repeated rows count once."""
    profiles = G.fit_profiles(lines(spark), "text", "label", 3000)
    rows = [("f", k, t) for k, t in enumerate(EN * 4 + FR)] + [("g", 100 + k, t) for k, t in enumerate(EN * 4)] + [("f", 0, EN[0])] + [(None, 200, EN[0]), ("h", 201, None), ("i", 202, " ")]
    df = spark.createDataFrame(rows, "file string, ocr_id int, text string")
    got = shares(df, profiles)
    # One of six lines this short may be misread.
    assert got.keys() == {("f", "eng"), ("f", "fre"), ("g", "eng"), (None, "eng")}
    assert got["f", "fre"][0] >= 5 and got["f", "eng"][0] + got["f", "fre"][0] == 18
    assert got["g", "eng"] == (12, 1.0) and got[None, "eng"] == (1, 1.0)
    assert shares(df.limit(0), profiles) == {}


def test_language_without_a_profile(spark):
    """Lines of languages far from all profiles are something else, and so is a track of them."""
    profiles = G.fit_profiles(lines(spark), "text", "label", 4000)
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Kissa nukkuu joka päivä lämpimällä ikkunalaudalla ja kehrää",
        "Książka leży na stole w kuchni obok okna", "Hän sanoi että huomenna tulee kaunis päivä", "Nie wiem gdzie jest mój klucz do mieszkania",
    ]
    unseen = ["Spark lets you write applications quickly in several languages", "My cat sleeps on the warm windowsill every afternoon", "We hold these truths to be self-evident"]
    assert (G.classify(strange, profiles)[0] == len(profiles.languages)).sum() >= 4
    assert (G.classify(EN + unseen, profiles)[0] == profiles.languages.index("eng")).all()
    rows = [("s", n, t) for n, t in enumerate(strange)] + [("m", 50 + n, t) for n, t in enumerate(strange + EN * 3)] + [("e", 100 + n, t) for n, t in enumerate(EN + unseen)]
    got = shares(spark.createDataFrame(rows, "file string, ocr_id int, text string"), profiles)
    assert ("s", G.OTHER) in got and ("s", "eng") not in got and {x for f, x in got if f == "m"} == {"eng", G.OTHER} and {x for f, x in got if f == "e"} == {"eng"}
