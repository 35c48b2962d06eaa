"""Operators against plain versions of themselves, held-out accuracy, and rows that once went wrong."""

import math
import os
import random
import re
import textwrap
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gaugeworks.llm import chat, common, jaccard, langid, licenses, mixing, packing, queries, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
driver_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


# Tokens


def test_ids_of_any_text_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, encode = Tokenizer.from_file(path), packing.BatchEncoder(path)
    assert encode.cutter is not None
    rng = random.Random(1)
    added = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|startOFtext|>"]
    letters = [*"\x00aAbBzZ019 .,'!<|>\"-\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 éÉßİΣσς̸̈ͅ中文٣½\U0001f600", "'s", "'RE", "'ll", "T̈", "the ", " and", *added]
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(4000)] + [f"see {a} here" for a in added] + [None, "", "x" * 70_000, "ab " * 100_000, "é" * 50_000, "'" * 999]
    for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)[:200]


def test_a_small_word_table_and_other_tokenizers(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcé", k=4)) for _ in range(60)) for _ in range(300)] + ["Some CASED words"]
    monkeypatch.setattr(packing, "ENTRIES", 64)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        got = [ids.tolist() for ids in packing.BatchEncoder(path)(pa.array(texts))]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# Toxicity


def plain_score(text, model):
    clear, spans = 1 - model.leak, []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        found = set(re.findall(r"[^\W\d_]+", m.group().lower()))
        if found:
            z = model.prior + sum(model.weights.get(t, 0.0) for w in found for t in [w + " "] + [w[:n] for n in range(4, min(8, len(w)) + 1)])
            p = 1 / (1 + math.exp(-max(-60.0, z)))
            clear *= 1 - min(p, 1 - 1e-12)
            spans.append((p, m.start(), m.end()))
    return 1 - clear, spans


@driver_tables
def test_toxicity_equals_its_plain_version_and_predicts(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in queries.op1_toxicity(spark, MIDDLE).collect()}
    model = toxicity.train(docs, labels, common.crc_mod("doc_id", 5) != 0)
    for r in docs.collect():
        score, spans = plain_score(r["text"], model)
        got = out[r["doc_id"]]
        assert got["score"] == pytest.approx(score, abs=1e-9) and got["predicted"] == (got["score"] >= 0.5)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if got["worst_score"] is not None:
            assert max(p for p, *_ in spans) == pytest.approx(got["worst_score"], abs=1e-9)
            assert (got["worst_start"], got["worst_end"]) in {(a, b) for p, a, b in spans if p == pytest.approx(got["worst_score"], abs=1e-9)}
    told = [(out[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["doc_id"] in out]
    assert np.mean([o["predicted"] == y for o, y in told if o["held_out"]]) > 0.85


def test_spans_are_places_in_the_text_as_it_is():
    model = toxicity.Model({"bad ": 12.0}, -10.0, 0.0)
    text = "İİİ x. bad bad. İ"
    *_, start, end, p = toxicity.score_text(text, model, model.words())
    assert text[start:end] == " bad bad" and p > 0.8


def test_training_reads_no_more_than_its_bounds(spark):
    docs = documents(spark, [(i, ("vile " if i % 2 else "kind ") * 100, "a") for i in range(40)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels, min_documents=1).weights == toxicity.train(docs, labels, min_documents=1, max_chars=10**6).weights
    assert not toxicity.train(docs, labels, max_chars=400).weights


# Language


def plain_language(text, filters):
    """By one look-up an n-gram and language."""
    masks = filters.array().reshape(langid.SLOTS, filters.words)
    fill = [np.mean(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) ** langid.HASHES for k in range(len(filters.languages))]
    grams = [g for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for n in (2, 3, 4) for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n))]
    if not grams:
        return "und", 0.0
    counts = Counter(grams)
    held = [sum(c for g, c in counts.items() if all(int(masks[s, k // 64]) >> k % 64 & 1 for s in langid.slots(g))) for k in range(len(fill))]
    share = [min(1.0, max(0.0, (h / len(grams) - f) / (1 - f))) for h, f in zip(held, fill, strict=True)]
    best = max(range(len(share)), key=lambda k: (share[k], -k))
    return filters.languages[best], share[best]


@driver_tables
def test_languages_equal_the_plain_version_and_are_right(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    filters = langid.train(docs, common.crc_mod("doc_id", 4) != 2)
    out = {r["doc_id"]: r for r in queries.op5_language_id(spark, SMALL).collect()}
    rows = docs.collect()
    for r in rows[:60]:
        lang, share = plain_language(r["text"], filters)
        assert out[r["doc_id"]]["lang_pred"] == lang and out[r["doc_id"]]["score"] == pytest.approx(share, abs=1e-9)
    held = [r for r in rows if out[r["doc_id"]]["held_out"] and r["lang"] and r["text"] and len(r["text"]) > 40]
    assert np.mean([out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_filters_equal_those_from_plain_counts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(30)), x) for i, (x, letters) in enumerate([("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghijkl")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(docs)
    counts, held = {}, Counter(x for *_, x in rows)
    for _, text, x in rows:
        counts.setdefault(x, Counter()).update(g for w in text.split() for g in langid.ngrams(w))
    want = langid.build({x: {g: n for g, n in own.items() if n >= 3} for x, own in counts.items()}, held)
    assert got == want


def test_samples_are_bounded_and_ties_go_to_the_better_known(spark):
    rows = [(i, f"text {i}", "big" if i % 5 else "small") for i in range(1000)]
    out = Counter(r["lang"] for r in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50).collect())
    assert out == {"big": 50, "small": 50}
    f = langid.build({"x": {"abc": 5}, "y": {"abc": 5}}, {"x": 1, "y": 2})
    assert langid.Predictor(f)("abc")[0] == "y"


# Licences


def plain_licences(text):
    """Every paragraph's family and probability, without anchors."""
    model, out = licenses.train(), []
    for k, line in enumerate(regex.sub(licenses.WRAPPED, " ", text or "").split("\n")):
        z = np.array(model.bias)
        for g in licenses.grams(licenses.tokens(line)):
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out.append((k, model.families[int(p.argmax())], float(p.max())))
    return out


@driver_tables
def test_licences_equal_the_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    got = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(docs).collect()}
    want = {(r["doc_id"], k): (f, p) for r in rows for k, f, p in plain_licences(r["text"]) if f != licenses.UNKNOWN and p >= 0.5}
    assert want and {k: (r["family"], pytest.approx(r["probability"])) for k, r in got.items() if r["family"] != licenses.UNKNOWN and r["probability"] >= 0.5} == want
    lines = {(r["doc_id"], k): line for r in rows for k, line in enumerate((r["text"] or "").split("\n"))}
    told = {k for k, line in lines.items() if re.search("(?i)licensed under|released under the", line)}
    assert told == {k for k, r in got.items() if r["confirmed"]}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_notices_are_one_paragraph(spark, mark):
    notices = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts if len(t) > 70]
    wrapped = [f"Some words first.\n\n{mark}" + f"\n{mark}".join(textwrap.wrap(t, 72)) + "\n\nMore words follow." for _, t in notices]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, [(i, t, None) for i, t in enumerate(wrapped)])).where("confirmed").collect()}
    assert [got[i]["family"] for i in range(len(notices))] == [f for f, _ in notices]


def test_other_wordings_and_probabilities_of_the_unknown():
    model = licenses.train()
    right, sure = [], []
    for family, texts in licenses.HELD_OUT.items():
        for t in texts:
            (_, f, p), *_ = plain_licences(t)
            right.append(f == family)
            sure.append(p)
    assert np.mean(right) > 0.9 and abs(np.mean(right) - np.mean(sure)) < 0.15
    assert plain_licences("")[0][1] == licenses.UNKNOWN and model.families[-1] == licenses.UNKNOWN


# Mixing


@driver_tables
def test_mixture_from_its_definition(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokens = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] or "" for r in docs.collect()}
    total = Counter()
    for i, n in tokens.items():
        total[source[i]] += n
    least, most = min(total.values()), max(total.values())
    # weight_i / tokens_i is share^(a-1); the largest ratio of two of these is (most / least)^(1-a) = 4 at the limit.
    a = max(0.0, 1 - math.log(4.0) / math.log(most / least)) if most > 4 * least else 0.0
    budget = {s: n * (n / most) ** (a - 1) for s, n in total.items()}
    out = queries.op8_source_mixing(spark, SMALL).collect()
    for s in total:
        own = sorted((r["token_start"], r["tokens"], r["doc_id"]) for r in out if r["source"] == s)
        assert all(n == tokens[i] for _, n, i in own)
        assert [at for at, *_ in own] == np.cumsum([0, *(n for _, n, _ in own)])[:-1].tolist()
        times = Counter(i for *_, i in own)
        assert set(times) == {i for i in tokens if source[i] == s} and max(times.values()) <= 4 + 1
        end = own[-1][0] + own[-1][1]
        assert end >= round(budget[s]) - 1 and own[-1][0] <= max(round(budget[s]) + 1, total[s])


def test_temperature_against_a_grid():
    tokens = {"a": 900, "b": 80, "c": 20}
    for h in (0.4, 0.7, 1.0):
        a = mixing.bisect_exponent(tokens, target_entropy=h)
        grid = [k / 2000 for k in range(2001)]
        first = next(k for k in grid if mixing.entropy({s: (n / 1000) ** k / sum((m / 1000) ** k for m in tokens.values()) for s, n in tokens.items()}) <= h)
        assert abs(a - first) <= 1 / 2000


# Near copies as the pipeline drops them


def test_rows_are_judged_by_their_own_text(spark):
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words), " ".join(reversed(words))
    near = " ".join([*words[:59], "x"])
    rows = [(5, one, "a"), (2, near, "a"), (2, two, "b"), (9, two, "c"), (7, "own text", "a"), (7, "own text", "a"), (7, "own  TEXT", "a"), (None, one, "a"), (None, "alone it is", "a"), (None, "alone it is", "a"), (None, None, "a"), (3, None, "a"), (3, None, "a"), (4, "", None)]
    out = jaccard.keep_first(documents(spark, rows))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(2, near), (2, two), (7, "own  TEXT"), (None, "alone it is"), (None, None), (3, None), (3, None), (4, "")])
    assert jaccard.keep_first(documents(spark, [])).count() == 0


def test_null_ids_link_like_others(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(8, text, "a"), (None, text + " more", "a"), (None, "all alone", "a"), (None, "All alone", "a")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(documents(spark, rows)).collect())
    assert got == Counter([(8, 38, 8), (None, 39, 8), (None, 1, None), (None, 1, None)])


# Chat


def test_trees_with_null_and_repeated_keys(spark):
    low = -(2**63)
    rows = [(None, 1, None, "a"), (None, 2, 1, "b"), (low, 1, None, "c"), (0, 1, None, "zero"), (4, 1, None, "x"), (4, 1, None, "y"), (4, 2, 1, "z"), (4, 2, 1, "z"), (4, None, 2, "n"), (4, None, 2, "m")]
    tree = spark.createDataFrame(rows, "conv_id long, node long, parent long, text string").withColumns({"role": F.lit("user"), "score": F.lit(None).cast("double")})
    out = chat.format_conversations(tree).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    got = Counter((r["conv_id"], "".join(t["text"] for t in r["t"])) for r in out)
    assert got == Counter([(None, "ab"), (low, "c"), (0, "zero"), (4, "y"), (4, "xz"), (4, "xzm"), (4, "xzn")])


def test_normal_forms_are_not_touched(spark):
    text = unicodedata.normalize("NFD", "é") + "\\<|"
    made = chat.format_conversations(chat.thread(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")))
    assert made.select(chat.read_loss(F.col("pieces")).alias("x")).first()["x"] == text


def test_number_signs_are_no_letters(spark):
    rows = [(k, f"the quick brown fox {k} jumps over the lazy dog" if k % 2 else f"der schnelle braune fuchs {k} springt über den hund", "en" if k % 2 else "de") for k in range(40)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["² ½", "①", "Ⅷ ³", "12 34", "_ -", "", None, "²the½quick", "ü"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), filters).collect()}
    assert [got[k] for k in range(8)] == ["und"] * 7 + ["en"] and got[8] != "und"
    assert all(langid.words_of(c) == [c.lower()] for c in "aéßñДж中한ªʰǅ") and not any(langid.words_of(c) for c in "²½①Ⅷ٣7_-")
    assert langid.words_of("x²the½ a1b") == ["x", "the", "a", "b"]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MASK_BYTES", langid.SLOTS * 8)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"), (F.col("id") % 65).cast("string").alias("lang"))
    with pytest.raises(ValueError, match="65 values"):
        langid.train(docs)


def test_rows_that_are_alike_are_packed_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    out = packing.pack_documents(docs, queries.tokenizer_path(), 8, 0)
    per = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32).alias("s")).count().collect()]
    assert sum(per) == 1000 and len(per) == 20 and max(per) < 120
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 8").count() == 0


def test_one_sided_bound_drops_no_pair(spark):
    """Whatever row fails it fails with every partner: all places of sets of up to 14 n-grams, at two thresholds."""
    rows = [(size, place, before) for size in range(1, 15) for place in range(size) for before in range(min(place, 3) + 1)]
    one = spark.createDataFrame([((p << 32) + s, b) for s, p, b in rows], "place long, before int")
    for num, den in ((9, 10), (4, 5)):
        kept = one.withColumn("ok", jaccard._may_link_any(num, den))
        both = kept.alias("l").crossJoin(kept.select(F.col("place").alias("o_place"), F.col("before").alias("o_before"), F.col("ok").alias("o_ok")))
        linked = both.where(jaccard._may_link("", "o_", num, den))
        assert linked.count() > 0 and linked.where("not ok or not o_ok").count() == 0
        assert kept.where("not ok").count() > 0
