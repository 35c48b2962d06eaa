"""The queries over the smallest driver tables, against SQL, and the pipeline end to end."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from gaugeworks.llm import mixing, queries, secrets, toxicity

from .test_secrets import masked as plain_mask

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    told = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[columns].itertuples(index=False, name=None)), key=str)
    assert told(got) == told(want)


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def near_groups(texts):
    """The smallest id of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i for i in texts if root[i] == i}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, DATA)
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    words = model.words()
    want = Counter({r: n for r, n in rows_of(docs).items() if toxicity.score_text(r[1], model, words)[0] < 0.5})
    assert rows_of(clean) == want and clean.columns == docs.columns

    apart = stages["near_copies"](spark, clean, DATA)
    first = near_groups({r[0]: r[1] for r in want})
    want = Counter({r: n for r, n in want.items() if r[0] in first})
    assert rows_of(apart) == want and apart.columns == docs.columns

    masked = stages["secrets"](spark, apart, DATA)
    secrets.forest_sql()
    want = Counter({(r[0], plain_mask(r[1] or "", r[3]) if r[1] else r[1], *r[2:]): n for r, n in want.items()})
    assert rows_of(masked) == want and masked.columns == docs.columns

    mixed = stages["mixing"](spark, masked, DATA)
    times = Counter(r["doc_id"] for r in mixing.mix(masked, tokenizer_path=queries.tokenizer_path()).collect())
    want = Counter({r: times[r[0]] for r in want})
    assert rows_of(mixed) == want and mixed.columns == docs.columns and min(times.values()) >= 1

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = Counter()
    for r, n in want.items():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, part in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048)):
            pieces[r[0], k, k * 2048, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += n
    for out in (stages["packing"](spark, mixed, DATA), corpus_pipeline.run(spark, DATA)):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == pieces
        assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
