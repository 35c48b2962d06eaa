"""Queries on geometry, intervals, planning, audits and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus, events, geometry, mining, planning, ranges, recordings, report
from ..operators.report import attempts
from ..sources import sinks
from . import tables as t
from .registry import query


@query("""SELECT c_custkey AS custkey, CASE WHEN c_custkey % 3 = 2 THEN 'new' ELSE 'old' END AS started_at, CASE WHEN c_custkey % 3 = 0 THEN 'f-old' ELSE 'f-new' END AS finished_at,
    CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE upper(c_name) END AS name FROM customer""")
def upsert_merge(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    row = lambda df, tag, name: df.select("custkey", F.lit(tag).alias("started_at"), F.lit(f"f-{tag}").alias("finished_at"), name.alias("name"))
    old, new = row(c.where("custkey % 3 <> 2"), "old", F.col("c_name")), row(c.where("custkey % 3 <> 0"), "new", F.upper("c_name"))
    return sinks.merge(old, new, ["custkey"], keep_old=("started_at",))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, sf_dir):
    done = t.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.pending(t.read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def fk_orphans(spark, sf_dir):
    return corpus.orphans(t.read(spark, sf_dir, "labels"), t.read(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT doc_id AS item_id, 'How many characters has ' || source || '?' AS question, 'numeric' AS answer_format, 'characters' AS unit FROM documents")
def query_projection(spark, sf_dir):
    items = t.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("How many characters has "), "source", F.lit("?")).alias("question"), F.lit("numeric").alias("answer_format"), F.lit(None).cast("map<string,string>").alias("options"),
        F.struct(F.col("n_chars").cast("double").alias("value"), F.lit("characters").alias("unit")).alias("answer_numeric"), "text",
    )
    return corpus.query_projection(items).drop("options")


@query("SELECT doc_id AS item_id, source AS env_id FROM documents WHERE lang IN ('fr', 'de') ORDER BY doc_id LIMIT 100")
def suite_filter_limit(spark, sf_dir):
    items = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("axis"), F.col("source").alias("env_id"))
    return corpus.suite_filter(items, axes=("fr", "de"), limit=100, order="item_id").select("item_id", "env_id")


@query("""SELECT coalesce(CASE WHEN l_quantity > 45 THEN 'too_many' END, CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_tax > 0.07 THEN 'tax' END, 'selected') AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def first_failing_reason(spark, sf_dir):
    rules = [("too_many", F.col("l_quantity") > 45), ("discount", F.col("l_discount") >= 0.09), ("returned", F.col("l_returnflag") == "R"), ("tax", F.col("l_tax") > 0.07)]
    return t.read(spark, sf_dir, "lineitem").groupBy(F.coalesce(planning.first_reason(rules), F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0")
def label_lookup_join(spark, sf_dir):
    labels = t.read(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return mining.labelled(t.read(spark, sf_dir, "supplier"), labels, ["s_nationkey"]).select(F.col("s_suppkey").alias("id"), "label")


def _near(spark, sf_dir):
    """Pairs among which are each vector's two nearest others of its label, by all components."""
    return geometry.nearest(t.read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 2)


_NEAR_SQL = """p AS (SELECT vec_id, label AS room, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.room = b.room AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS k, lead(dist) OVER (PARTITION BY vec_id ORDER BY dist, other) - dist AS margin FROM d)"""


@query(f"WITH {_NEAR_SQL} SELECT vec_id, other AS nn_id, round(dist, 6) AS dist FROM r WHERE k = 1")
def nearest_neighbours(spark, sf_dir):
    return geometry.nearest_with_margin(_near(spark, sf_dir), "vec_id").select("vec_id", F.col("nn").alias("nn_id"), F.round("dist", 6).alias("dist"))


@query(f"WITH {_NEAR_SQL} SELECT vec_id, round(margin, 6) AS margin, coalesce(margin >= 0.05, false) AS kept FROM r WHERE k = 1")
def nn_margin(spark, sf_dir):
    return geometry.nearest_with_margin(_near(spark, sf_dir), "vec_id").select("vec_id", F.round("margin", 6).alias("margin"), F.coalesce(F.col("margin") >= 0.05, F.lit(False)).alias("kept"))


@query("""WITH d AS (SELECT s_suppkey AS subject, c_nationkey AS gold, n_name AS label, abs(n_nationkey - c_nationkey) AS dist FROM supplier JOIN customer ON c_custkey = s_suppkey CROSS JOIN nation WHERE n_nationkey <> c_nationkey),
    m AS (SELECT subject, label, min(dist) AS dist FROM d GROUP BY ALL) SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY dist, label) AS INTEGER) AS rank, label FROM m QUALIFY rank <= 3""")
def distinct_topk_distractors(spark, sf_dir):
    s, c, n = (t.read(spark, sf_dir, x) for x in ("supplier", "customer", "nation"))
    near = s.join(c, F.col("c_custkey") == F.col("s_suppkey")).crossJoin(F.broadcast(n))  # 25 nations
    gold = F.broadcast(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("gold")))
    pairs = near.join(gold, "c_nationkey").select(F.col("s_suppkey").alias("subject"), "gold", F.col("n_name").alias("label"), F.abs(F.col("n_nationkey") - F.col("c_nationkey")).alias("dist"))
    return geometry.distinct_distractors(pairs, "subject", "label", "gold")


@query("""WITH p AS (SELECT vec_id, label AS room, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id AS other_id
    FROM p a JOIN p b ON a.room = b.room AND a.vec_id <> b.vec_id QUALIFY rank <= 3""")
def cosine_topk(spark, sf_dir):
    rows = geometry.nearest(t.read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 3, "cos")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cos"), "other")))
    return ranked.where("rank <= 3").select("vec_id", "rank", F.col("other").alias("other_id"))


def _axis(i: int, n: int = 8) -> list[float]:
    return [1.0 if k == i else 0.0 for k in range(n)]


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS m, CAST(embedding[9:16] AS DOUBLE[]) AS q FROM embeddings),
    g AS (SELECT vec_id, substr('ABCDE', CAST(i AS BIGINT), 1) AS choice, m[i] / sqrt(list_inner_product(m, m)) - q[i] / sqrt(list_inner_product(q, q)) AS gain, i FROM v, range(1, 6) r(i))
    SELECT vec_id, choice FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gain DESC, i) = 1""")
def calibrated_argmax(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    options = [(letter, F.array(*map(F.lit, _axis(i)))) for i, letter in enumerate("ABCDE")]
    return t.read(spark, sf_dir, "embeddings").select("vec_id", geometry.calibrated_choice(F.slice(v, 9, 8), F.slice(v, 1, 8), options).alias("choice"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS m, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
    g AS (SELECT vec_id, i, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE round((m[i] - m[65 - i]) / n, 9) END AS gain FROM v, range(1, 65) r(i))
    SELECT vec_id, 'o' || lpad(CAST(i AS VARCHAR), 2, '0') AS choice FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gain DESC, i) = 1""")
def calibrated_choice(spark, sf_dir):
    """The same over all 64 components and 64 options, the query being the vector backwards; a seventh has no memory."""
    v = F.col("embedding").cast("array<double>")
    options = [(f"o{i + 1:02}", F.array(*map(F.lit, _axis(i, 64)))) for i in range(64)]
    return t.read(spark, sf_dir, "embeddings").select("vec_id", geometry.calibrated_choice(F.reverse(v), F.when(F.col("vec_id") % 7 != 0, v), options).alias("choice"))


@query("""WITH m AS (SELECT label, dim, avg(CAST(embedding[dim] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(dim) GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT label, 'mean' AS kind, n AS n_records, CAST(512 AS BIGINT) AS memory_bytes, (SELECT round(sum(x), 6) FROM m WHERE m.label = n.label) AS total FROM n UNION ALL SELECT label, 'none', 0, 0, NULL FROM n""")
def memory_substrates(spark, sf_dir):
    rows = t.read(spark, sf_dir, "embeddings")
    state = lambda kind: geometry.memory_state(rows, "label", "embedding", kind).withColumn("kind", F.lit(kind))
    total = F.round(F.aggregate("memory", F.lit(0.0), lambda a, x: a + x), 6)
    return state("mean").unionByName(state("none")).select("label", "kind", "n_records", "memory_bytes", total.alias("total"))


@query("SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(dim) GROUP BY label, dim")
def vector_mean(spark, sf_dir):
    return geometry.vector_mean(t.read(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS span_id, l_suppkey AS video, CAST(l_orderkey % 1000 AS DOUBLE) AS start, l_orderkey % 1000 + l_quantity AS stop FROM lineitem),
    c AS (SELECT o_orderkey AS chunk_id, o_custkey % 100 + 1 AS video, CAST(o_orderkey % 1000 AS DOUBLE) AS start, CAST(o_orderkey % 1000 + 20 AS DOUBLE) AS stop FROM orders)
    SELECT span_id, chunk_id, greatest(s.start, c.start) AS lo, least(s.stop, c.stop) AS hi FROM s JOIN c ON s.video = c.video AND s.start < c.stop AND c.start < s.stop AND s.stop > s.start""")
def interval_overlap_join(spark, sf_dir):
    li, o = t.read(spark, sf_dir, "lineitem"), t.read(spark, sf_dir, "orders")
    at = F.col("l_orderkey") % 1000
    spans = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), F.col("l_suppkey").alias("video"), at.cast("double").alias("start"), (at + F.col("l_quantity")).alias("stop"))
    at = F.col("o_orderkey") % 1000
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 100 + 1).alias("video"), at.cast("double").alias("start"), (at + 20).cast("double").alias("stop"))
    return planning.overlaps(spans, chunks, "video", 50.0)


@query("""WITH q AS (SELECT DISTINCT conv_id AS query_id, CASE WHEN conv_id % 5 = 0 THEN -1 ELSE conv_id % 8 END AS cutoff FROM conversations)
    SELECT query_id, (SELECT count(*) FROM conversations c WHERE q.cutoff = -1 OR c.turn <= q.cutoff) AS n_visible FROM q""")
def cutoff_range_join(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations")
    queries = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("cutoff", F.when(F.col("query_id") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("query_id") % 8))
    return planning.visible_counts(queries, c, "cutoff", "turn", "query_id")


@query("""WITH g AS (SELECT DISTINCT user_id, 1704067200000000 + d * 86400000000 AS target FROM events, range(0, 30, 3) r(d)), e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events)
    SELECT g.user_id, g.target, coalesce((SELECT e.event_id FROM e WHERE e.user_id = g.user_id AND e.us >= g.target ORDER BY e.us, e.event_id LIMIT 1), (SELECT e.event_id FROM e WHERE e.user_id = g.user_id ORDER BY e.us DESC, e.event_id DESC LIMIT 1)) AS event_id FROM g""")
def asof_forward_join(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select("user_id", t.epoch("ts").alias("us"), "event_id")
    day = F.explode(F.sequence(F.lit(0), F.lit(27), F.lit(3)))
    targets = rows.select("user_id").distinct().withColumn("d", day).select("user_id", (F.lit(1704067200000000) + F.col("d") * F.lit(86400000000)).alias("target"))
    return planning.asof_forward(targets, rows, "user_id", "us", "event_id")


@query("""WITH e AS (SELECT user_id, round(max(value), 2) AS stop FROM events GROUP BY 1)
    SELECT user_id, CAST(i AS INTEGER) AS idx, i * 25.0::DOUBLE AS start, least((i + 1) * 25.0::DOUBLE, stop) AS stop FROM e, range(0, 1000) r(i) WHERE i * 25.0::DOUBLE < stop - 0.001::DOUBLE""")
def fixed_chunks(spark, sf_dir):
    ends = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.max("value"), 2).alias("end"))
    return planning.fixed_chunks(ends, "end", 25.0).select("user_id", "idx", "start", "stop")


@query("""WITH u AS (SELECT user_id, CAST(user_id % 10 + 1 AS INTEGER) AS n, round(min(value), 2) AS lo, round(max(value), 2) AS hi FROM events GROUP BY 1)
    SELECT user_id, n, CAST(i AS INTEGER) AS i, round(lo + (hi - lo) / n * (i + 0.5::DOUBLE), 9) AS t FROM u, range(0, 10) r(i) WHERE i < n""")
def midpoint_grid(spark, sf_dir):
    spans = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.min("value"), 2).alias("lo"), F.round(F.max("value"), 2).alias("hi")).withColumn("n", (F.col("user_id") % 10 + 1).cast("int"))
    return spans.select("user_id", "n", F.posexplode(planning.midpoints(F.col("lo"), F.col("hi"), F.col("n"))).alias("i", "t")).withColumn("t", F.round("t", 9))


@query("SELECT l_orderkey AS key, count(DISTINCT l_suppkey) AS n_sessions, max(l_linenumber + l_quantity) - min(l_linenumber) AS span FROM lineitem GROUP BY 1")
def evidence_span(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.countDistinct("l_suppkey").alias("n_sessions"), (F.max(F.col("l_linenumber") + F.col("l_quantity")) - F.min("l_linenumber")).alias("span"))


@query("SELECT count(*) AS n_shared, count(*) FILTER (doc_id % 50 = 0) AS n_mismatch FROM documents")
def cross_run_consistency(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("gold"))
    other = d.withColumn("gold", F.when(F.col("doc_id") % 50 == 0, F.lit("changed")).otherwise(F.col("gold")))
    return corpus.mismatches(d, other, "doc_id", ["lang", "gold"])


@query(f"WITH {_NEAR_SQL}, n AS (SELECT vec_id AS s, other AS g FROM r WHERE k = 1) SELECT x.s AS a, x.g AS b FROM n x JOIN n y ON x.s = y.g AND x.g = y.s AND x.s < y.s")
def reciprocal_pairs(spark, sf_dir):
    near = geometry.nearest_with_margin(_near(spark, sf_dir), "vec_id").select(F.lit(0).alias("scan"), F.col("vec_id").alias("subject"), F.col("nn").alias("gold"))
    return mining.reciprocal_pairs(near)


@query("""WITH a AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
    l AS (SELECT * FROM a QUALIFY attempt = max(attempt) OVER (PARTITION BY user_id)) SELECT user_id, CAST(max(attempt) AS BIGINT) AS attempt, count(*) AS n FROM l GROUP BY 1""")
def trace_last_attempt(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    counted = attempts(rows, "user_id", "at", F.col("event_type") == "signup").groupBy("user_id", "attempt").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(F.max("attempt").alias("attempt"), F.max_by("n", "attempt").alias("n"))


@query("SELECT o_custkey AS participant, l_partkey AS object, count(DISTINCT l_suppkey) AS n_places, count(DISTINCT o_orderkey) AS n_sessions FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING n_places >= 2 AND n_sessions >= 2")
def relocation_candidates(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    placed = rows.select(F.col("o_custkey").alias("participant"), F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("place"), F.col("o_orderkey").alias("session"))
    return mining.relocation_candidates(placed, 2, 2)


@query("SELECT l_returnflag AS flag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS v FROM lineitem GROUP BY 1")
def upper_median(spark, sf_dir):
    return report.index_percentiles(t.read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_quantity", {"v": (1, 2)}, ["flag"])


@query("WITH l AS (SELECT list_sort(list(l_quantity)) AS q, count(*) AS n FROM lineitem) SELECT q[n // 10 + 1] AS p10, q[n // 2 + 1] AS p50, q[9 * n // 10 + 1] AS p90, q[n] AS pmax FROM l")
def index_percentiles(spark, sf_dir):
    return report.index_percentiles(t.read(spark, sf_dir, "lineitem"), "l_quantity", {"p10": (1, 10), "p50": (1, 2), "p90": (9, 10), "pmax": (1, 1)})


# Groups larger than a task should hold: all rows are one or three groups, in ranges of 2,000 rows at most.


@query("""WITH l AS (SELECT l_returnflag AS flag, list_sort(list(l_extendedprice)) AS q, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT flag, q[n // 10 + 1] AS p10, q[n // 2 + 1] AS p50, q[9 * n // 10 + 1] AS p90, q[n] AS pmax FROM l""")
def hot_index_percentiles(spark, sf_dir):
    points = {"p10": (1, 10), "p50": (1, 2), "p90": (9, 10), "pmax": (1, 1)}
    return report.index_percentiles(t.read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", points, ["flag"], range_rows=2000)


@query("SELECT round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.999), 6) AS p999 FROM lineitem")
def hot_linear_percentiles(spark, sf_dir):
    out = ranges.linear_percentiles(t.read(spark, sf_dir, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p999": 0.999}, range_rows=2000)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS pos, min('f' || l_partkey) AS frame, max('f' || l_partkey) AS final FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1), a AS (SELECT DISTINCT o_orderkey * 10 + o_custkey % 9 AS target FROM orders),
    b AS (SELECT target, frame FROM a ASOF LEFT JOIN r ON a.target <= r.pos) SELECT 0 AS recording, target, coalesce(frame, (SELECT max_by(final, pos) FROM r)) AS frame FROM b""")
def hot_asof_forward(spark, sf_dir):
    li, o = t.read(spark, sf_dir, "lineitem").where("l_linenumber <> 2"), t.read(spark, sf_dir, "orders")
    frames = li.select(F.lit(0).alias("recording"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.concat(F.lit("f"), "l_partkey").alias("frame"))
    targets = o.select(F.lit(0).alias("recording"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 9).alias("target")).distinct()
    return planning.asof_forward(targets, frames, "recording", "at", "frame", range_rows=2000)


@query("""WITH a AS (SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS attempt FROM events) SELECT CAST(attempt AS BIGINT) AS attempt, min(event_id) AS first_event, count(*) AS n FROM a GROUP BY 1""")
def hot_attempts(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("env", F.lit("one"))
    counted = attempts(rows, "env", ["ts", "event_id"], F.col("event_type") == "signup", range_rows=2000)
    return counted.groupBy("attempt").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type AS best, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c ORDER BY n DESC, event_type LIMIT 1")
def constant_guesser_ceiling(spark, sf_dir):
    return mining.guesser_ceiling(t.read(spark, sf_dir, "events"), "event_type")


@query("SELECT lang AS axis, count(DISTINCT source) AS n_letters FROM documents GROUP BY 1")
def alphabet_per_axis(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("axis")).agg(F.countDistinct("source").alias("n_letters"))


@query("SELECT max(n) / CAST(sum(n) AS DOUBLE) AS top_share FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def top_share(spark, sf_dir):
    return corpus.top_share(t.read(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT n_orders, count(*) AS n_customers FROM (SELECT count(*) AS n_orders FROM orders GROUP BY o_custkey) GROUP BY 1")
def count_of_counts(spark, sf_dir):
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sequence"), F.col("o_orderkey").alias("instance_id"), F.lit("dynamic").alias("motion_type"))
    return recordings.instance_inventory(rows).select(F.col("n_dynamic").alias("n_orders"), F.col("n_sequences").alias("n_customers"))


@query("SELECT c_acctbal AS key, min(c_mktsegment) AS value FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 1")
def unambiguous_key(spark, sf_dir):
    return planning.unambiguous(t.read(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def last_known_value(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return events.last_known(rows, "user_id", "event_id", "event_type")


@query("SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, p LIMIT 20")
def topk_groups(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(20)


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS rn FROM documents ORDER BY rn, lang LIMIT 40")
def round_robin_sample(spark, sf_dir):
    return corpus.round_robin(t.read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 40).select("doc_id", "rn")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM orders) SELECT CAST(i AS INTEGER) AS i, o_orderkey FROM range(0, 22) r(i) JOIN o ON o.at = i * 1000 // 22")
def thin_evenly(spark, sf_dir):
    return corpus.thin_evenly(t.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000, 22).select("i", "o_orderkey")


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT substr('ABCD', CAST(i + 1 AS BIGINT), 1) AS letter, (n + 3 - i) // 4 AS n FROM n, range(0, 4) r(i)")
def balanced_assignment(spark, sf_dir):
    return mining.balanced(t.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").groupBy("letter").agg(F.count("*").alias("n"))


def _cover(steps: int, budget: float) -> str:
    """The cover in SQL, one session a step; sizes are 1 at least, so ``budget`` steps are enough."""
    value = "(4 * count(*) FILTER (n = 1) + count(*)) / greatest(any_value(cost), 0.01)"
    out = ["t0 AS (SELECT 0 AS step, '' AS session, 0.0::DOUBLE AS spent WHERE false)"]
    for k in range(1, steps + 1):
        best = f"SELECT session, any_value(cost) AS cost, {value} AS value FROM (SELECT *, count(*) OVER (PARTITION BY candidate) AS n FROM p WHERE session NOT IN (SELECT session FROM t{k - 1})) GROUP BY session ORDER BY value DESC, cost, session LIMIT 1"
        told = f"(SELECT coalesce(max(spent), 0) FROM t{k - 1})"
        out.append(f"t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} UNION ALL SELECT {k - 1}, session, {told} + cost FROM ({best}) WHERE {told} + cost <= {budget} AND (SELECT count(*) FROM t{k - 1}) = {k - 1})")
    return ", ".join(out)


@query(f"""WITH p AS MATERIALIZED (SELECT DISTINCT l_partkey AS candidate, 's' || l_suppkey AS session, CAST(CASE WHEN l_suppkey % 7 = 0 THEN 3 ELSE l_suppkey % 7 END AS DOUBLE) AS cost FROM lineitem), {_cover(20, 20.0)}
    SELECT CAST(step AS INTEGER) AS step, session, spent FROM t20""")
def greedy_cover(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("session")).distinct()
    sizes = t.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("session"), (F.col("s_suppkey") % 7).cast("double").alias("size"))
    return planning.greedy_cover(rows, sizes, 20.0, 3.0)


@query("""WITH RECURSIVE h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_partkey) AS i, l_partkey AS id, list(DISTINCT l_suppkey % 12) AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, []::BIGINT[] AS used, CAST(0 AS BIGINT) AS n, '' AS verdict UNION ALL
        SELECT h.i, h.id, CASE WHEN len(list_distinct(used || h.h)) <= 9 AND n < 100 THEN list_distinct(used || h.h) ELSE used END, n + CASE WHEN len(list_distinct(used || h.h)) <= 9 AND n < 100 THEN 1 ELSE 0 END,
            CASE WHEN len(list_distinct(used || h.h)) > 9 THEN 'video_budget' WHEN n >= 100 THEN 'item_limit' ELSE 'chosen' END
        FROM w JOIN h ON h.i = w.i + 1)
    SELECT id, verdict FROM w WHERE i > 0""")
def history_budget(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 12).alias("history"))
    return planning.budget_verdicts(rows, "id", 9, 100).select("id", "verdict")


_PHASE = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"


@query(f"WITH p AS (SELECT user_id, {_PHASE} AS p, lag({_PHASE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count(*) FILTER (b > p) AS n_bad FROM p GROUP BY 1")
def protocol_order_violations(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    kinds = F.create_map(*map(F.lit, ("signup", "env_begin", "view", "ingest", "click", "ingest_end", "purchase", "query", "error", "env_end")))
    return events.order_violations(rows, "user_id", "at", events.phase_rank(kinds[F.col("event_type")]))


@query("""WITH l AS (SELECT event_type, count(*) FILTER (event_type = 'view') OVER w > 0 AS asked, count(*) FILTER (event_type = 'error') OVER w > 0 AS late
        FROM events WINDOW w AS (PARTITION BY user_id, event_id % 20 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT CASE WHEN NOT asked THEN 'orphan' WHEN late THEN 'late' ELSE 'on_time' END AS class, count(*) AS n FROM l WHERE event_type = 'click' GROUP BY 1""")
def late_answer_classification(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "click", "answer").otherwise("other")
    log = t.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("item"), "event_id", kind.alias("type"))
    return events.classify_answers(log, ["user_id", "item"], "event_id").groupBy(F.col("standing").alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN user_id % 17 = 0 THEN 'error' WHEN event_type = 'click' THEN 'ok' WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'error' THEN 'malformed' ELSE 'error' END AS status, count(*) AS n FROM events GROUP BY 1""")
def failure_propagation(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "view", "timeout").when(F.col("event_type") == "error", "protocol_error")
    rows = t.read(spark, sf_dir, "events").select(events.item_status(outcome, F.col("user_id") % 17 == 0, F.lit(False)).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id AS env, event_type = 'signup' AS deferred, CAST(floor(value / 20) AS BIGINT) AS frames FROM events)
    SELECT env, CAST(CASE WHEN coalesce(sum(frames) FILTER (NOT deferred), 0) = 0 THEN coalesce(max(frames) FILTER (deferred), 0) ELSE sum(frames) FILTER (NOT deferred) END AS BIGINT) AS total_frames, count(*) FILTER (NOT deferred AND frames = 0) AS blank FROM a GROUP BY 1""")
def frame_accounting(spark, sf_dir):
    acks = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("env"), (F.col("event_type") == "signup").alias("deferred"), F.floor(F.col("value") / 20).cast("long").alias("frames"))
    return events.frame_accounting(acks, "env")
