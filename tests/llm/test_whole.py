"""Places where the training-data operators once saw a part of their input only."""

import random

from gaugeworks.llm import langid, secrets

HEXES = "0123456789abcdef"


def hexes(seed, n=40):
    return "".join(random.Random(seed).choices(HEXES, k=n))


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, "src/app") for i, t in enumerate(rows)], "doc_id long, text string, source string")


def test_every_occurrence_of_a_secret_is_scored(spark):
    key, other = hexes(1), hexes(2)
    docs = texts(spark, f"see commit {key} é\U0001f600 there\nand then token = {key}\n", f"{key}abc/{other} was found in it; secret = {key}", f"commit {key} only", f"{key} twice {key}")
    got = {}
    for r in secrets.scan(docs).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["is_secret"]))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    second = rows[0].index(key, 20)
    assert got[0] == [(12, 40, False), (second + 1, 40, True)]
    assert got[1][1] == (rows[1].index("= ") + 3, 40, True) and got[1][0][:2] == (1, 84)
    assert got[2] == [(8, 40, False)] and [p[0] for p in got[3]] == [1, 48]
    red = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert red[0] == rows[0].replace(key, secrets.MASK) and red[2] == rows[2] and key not in red[1]


def test_runs_of_any_length_are_scanned(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    blob = lambda n: "MII" + "".join(rng.choices(letters + "+/", k=n))
    issued = "ghp_" + "".join(rng.choices(letters, k=36))
    plain = "/".join(["page", "index", "user", "table7"] * 40)
    long = [f"PRIVATE_KEY={blob(1640)}==", f"api_key: {blob(510)} end", f"see {plain}/{issued}/{plain} there", f"see {plain} there", f"private_key={blob(200_000)}"]
    docs = texts(spark, *long)
    got = {r["doc_id"]: (r["length"], r["is_secret"]) for r in secrets.scan(docs).collect()}
    assert got == {0: (1645, True), 1: (513, True), 2: (2 * len(plain) + 42, True), 3: (len(plain), False), 4: (200_003, True)}
    red = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert red[0] == "PRIVATE_KEY=[SECRET]" and red[1] == "api_key: [SECRET] end" and issued not in red[2] and red[3] == long[3]


def test_more_languages_than_a_mask_word_has_bits():
    rng = random.Random(6)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(150)}
    counts = {x: {g: 5 for w in own for g in langid.ngrams(w)} for x, own in words.items()}
    predictor = langid.Predictor(langid.build(counts, dict.fromkeys(words, 1)))
    assert len(predictor.languages) == 150
    assert {x: predictor(" ".join(own))[0] for x, own in words.items()} == {x: x for x in words}
