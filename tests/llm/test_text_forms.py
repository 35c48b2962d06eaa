"""Fill-in-the-middle, SentencePiece and run detection against plain versions, and their defined results."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaugeworks.llm import fim, pieces, queries, runs

SMALL = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
LETTERS = [*" aab0_-.,\n\t\r\x0b\x0céßñ中文한\U0001f600́▁ ", "the ", "  ", "<P", "<S>", "M>", "<"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return [None, "", " ", "a", "中", *("".join(rng.choices(LETTERS, k=rng.randrange(longest))) for _ in range(n))]


def frame(spark, texts, kind="long"):
    rows = [(None if k % 50 == 7 else k * 3 - 40, t, "x", k) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, f"doc_id {kind}, text string, form string, n int")


# Fill in the middle


def plain_units(text, unit):
    return list(text) if unit == "char" else re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+|[ \t\n\v\f\r]+|[\x00-\x7f]", text)


def plain_fim(doc_id, text, unit="char", plain=10, spm=20, markers=fim.MARKERS):
    text, told = text or "", "" if doc_id is None else str(doc_id)
    parts, h = plain_units(text, unit), [int(sha(f"1:{told}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in markers) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, None, None, text
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    p, s, m = markers
    form, out = ("spm", s + suf + p + pre + m + mid) if h[3] % 100 < spm else ("psm", p + pre + s + suf + m + mid)
    return n, form, a, b - a, len(pre), len(mid), out


@pytest.mark.parametrize(("unit", "markers"), [("char", fim.MARKERS), ("word", ("[pre]", "[suf]", "[mid]"))])
def test_cuts_equal_lists_of_units(spark, unit, markers):
    rows, docs = frame(spark, some_texts(1500))
    made = fim.transform(docs, 10, 40, unit, markers).withColumn("back", fim.restored(F.col("output"), F.col("form"), markers))
    got = [(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()]
    assert got == [(i, t or "", *plain_fim(i, t, unit, 10, 40, markers)) for i, t, *_ in rows]
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert all(r["back"] == r["text"] for r in made.collect())


def test_fim_of_odd_tables(spark):
    _, docs = frame(spark, [])
    assert fim.transform(docs).collect() == []
    long = "ab é中" * 300_000
    twice = spark.createDataFrame([("k", long), ("k", long)], "doc_id string, text string")
    made = fim.transform(twice, plain_percent=0).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert made[0] == made[1] and made[0]["n"] == len(long) and made[0]["back"] == long and made[0]["form"] != "plain"
    for markers in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P", "P<", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(twice, markers=markers)
    with pytest.raises(ValueError):
        fim.transform(twice, unit="line")


@driver_tables
def test_fim_restores_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op11_fill_in_middle(spark, SMALL).collect()
    assert len(out) == len(texts) and all(r["restored_sha256"] == sha(texts[r["doc_id"]]) for r in out)


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(queries.piece_model_path())


def ids_of(encoder, texts):
    return [part[a:b].tolist() for _, part, at in encoder(pa.array(texts, pa.string())) for a, b in zip(at, at[1:])]


def test_ids_equal_the_library(library, encoder, monkeypatch):
    rng, pool = random.Random(3), [library.id_to_piece(i) for i in range(3, 32000)]
    texts = some_texts(3000) + ["".join(rng.choices(pool, k=rng.randrange(9))) for _ in range(5000)]
    texts += ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(900))) for _ in range(60)]
    texts += [" " * 3001, "x" + " " * 50_000 + "the", "=" * 4000, "io" * 2000 + "n", "the" * 999, "<s></s><0x0A><unk>", "\0\0", "a▁b", "é" * 700]
    texts += [chr(c) for c in range(1, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert ids_of(encoder, texts) == want
    monkeypatch.setattr(pieces, "ENTRIES", 50)  # the table is emptied again and again
    monkeypatch.setattr(pieces, "SWEEP", 0)  # all risky pairs are swept
    assert ids_of(pieces.PieceEncoder(queries.piece_model_path()), texts) == want


def test_words_that_share_a_hash_stay_apart(library, encoder, monkeypatch):
    own = pieces._hashes
    monkeypatch.setattr(pieces, "_hashes", lambda data, starts: (own(data, starts)[0] % np.uint64(3), own(data, starts)[1]))
    texts = [f"alpha beta {k} gamma {k * 7} delta" for k in range(50)]
    assert ids_of(pieces.PieceEncoder(queries.piece_model_path()), texts) == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_encode_and_decode_frames(spark, library):
    path = queries.piece_model_path()
    rows, docs = frame(spark, some_texts(200))
    made = pieces.encode(docs, path, decoded=True)
    want = [library.encode(t or "", add_bos=True, add_eos=True) for _, t, *_ in rows]
    got = made.collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want and [r["n_tokens"] for r in got] == [len(w) for w in want]
    assert [r["doc_id"] for r in got] == [r[0] for r in rows] and [r["decoded"] for r in got] == [library.decode(w) for w in want]
    assert [r["text"] for r in pieces.decode(made, path).collect()] == [library.decode(w) for w in want]
    odd = spark.createDataFrame([(1, None), (2, b"")], "doc_id int, ids binary")
    assert [tuple(r) for r in pieces.decode(odd, path).collect()] == [(1, ""), (2, "")]
    assert pieces.encode(docs.limit(0), path).collect() == []


def test_other_models_are_refused(tmp_path):
    with open(queries.piece_model_path(), "rb") as f:
        told = f.read()
    path = tmp_path / "other.model"
    path.write_bytes(told[: told.rindex(b"identity") - 4])  # the part on normalisation is gone, and its defaults are others
    with pytest.raises((ValueError, IndexError)):
        pieces.Model(str(path))


@driver_tables
def test_op12_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op12_sentencepiece(spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == sha(library.decode(ids))


# Runs


def plain_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_many_sequences_at_once():
    rng = random.Random(5)
    for _ in range(400):
        seqs = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choices(range(rng.choice([1, 2, 3, 9])), k=rng.randrange(60))
            if s and rng.random() < 0.5:
                a = rng.randrange(len(s))
                p = 1 + rng.randrange(len(s) - a)
                s = [s[i if i < a else a + (i - a) % p] for i in range(len(s))]
            seqs.append(s)
        if not any(seqs):
            continue
        of = np.concatenate([np.full(len(s), k) for k, s in enumerate(seqs)])
        found = runs.Forest.build(of, np.concatenate([np.array(s, np.int64) for s in seqs])).runs(m := rng.choice([1, 2, 12]))
        base, want = 0, []
        for s in seqs:
            want += [(a + base, n, q) for a, n, q in plain_runs(s, m)]
            base += len(s)
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def test_find_runs_in_texts(spark, monkeypatch):
    monkeypatch.setattr(runs, "LISTED", 100)
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a", "one  two\tone two one two one two one two one two one two x", "é é é " * 8, "w" * 300 + " " + ("v" * 300 + " ") * 13, "a " * 9, "a " * 12]
    texts += ["".join(rng.choice(["é", "a", "b", "c"][: 1 + k % 4]) + rng.choice([" ", "  ", "\n", "\r\n"]) for _ in range(rng.randrange(80))) for k in range(150)]
    rows, docs = frame(spark, texts)
    out = runs.find(docs).collect()
    assert [r["doc_id"] for r in out] == [r[0] for r in rows]
    for r, (_, t, *_) in zip(out, rows, strict=True):
        w = plain_words(t)
        found = plain_runs(w)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(w), found, plain_collapsed(w, found)), t
    assert sum(bool(r["runs"]) for r in out) > 20
    assert runs.find(docs.limit(0)).collect() == []
    assert runs.find(spark.createDataFrame([("k", "a b " * 90_000)] * 2, "doc_id string, text string")).select("runs", "collapsed").distinct().collect() == [([(0, 180_000, 2)], "a b")]


def test_words_that_share_a_first_hash():
    h, h2 = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    of = runs.word_numbers(h, h2)
    assert of[0] == of[3] and len(set(of.tolist())) == 3


@driver_tables
def test_op13_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op13_periodic_runs(spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        w, h = plain_words(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        _, number = np.unique(np.array(w, object), return_inverse=True) if w else (None, np.zeros(0, int))
        found = numpy_runs(number)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in found)) and r["collapsed_sha256"] == sha(plain_collapsed(w, found))


def numpy_runs(w):
    """All runs by comparing the words with themselves at every distance."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edge = np.nonzero(same[1:] != same[:-1])[0]
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(12, 2 * q):
                out.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))
