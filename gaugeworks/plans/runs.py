"""Queries on logs, suites, runs, identifiers, scans and mined questions, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import corpus, events, mining, planning, recordings, report, runs, scans
from ..sources import archives, readers, sinks
from ..streaming import live, sessions
from . import tables as t
from .registry import query

# --- sources: lines of logs -------------------------------------------------

_LOG_SQL = """log AS (SELECT event_id, 'u' || user_id AS item_id, event_type AS answer, event_id % 9 = 4 AS torn FROM events)"""


def _log(spark, sf_dir):
    """A prediction log of one line an event; each ninth is torn."""
    e = t.read(spark, sf_dir, "events")
    whole = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("item_id"), F.lit("r").alias("run_id"), F.col("event_type").alias("answer"), F.lit("ok").alias("status")))
    return e.select(F.when(F.col("event_id") % 9 == 4, F.left(whole, F.length(whole) - 3)).otherwise(whole).alias("value"), F.col("event_id").alias("ord"))


@query(f"WITH {_LOG_SQL} SELECT item_id, answer, event_id AS ord FROM log WHERE NOT torn QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY event_id DESC) = 1")
def prediction_log(spark, sf_dir):
    return readers.parse_predictions(_log(spark, sf_dir)).select("item_id", "answer", "ord")


@query(f"WITH {_LOG_SQL} SELECT answer, count(*) AS n FROM log WHERE NOT torn GROUP BY 1")
def lenient_lines(spark, sf_dir):
    return readers.parse_jsonl(_log(spark, sf_dir), "item_id string, answer string", "item_id").groupBy("answer").agg(F.count("*").alias("n"))


@query(f"WITH {_LOG_SQL} SELECT count(*) FILTER (NOT torn) AS n_rows, count(*) FILTER (torn) AS n_corrupt FROM log")
def corrupt_line_count(spark, sf_dir):
    blank = spark.createDataFrame([("",), ("  ",), ("[1]",), ("7",)], "value string")
    return readers.count_corrupt(_log(spark, sf_dir).select("value").unionByName(blank))


@query("SELECT 'd' || doc_id AS item_id, CAST(quality AS DOUBLE) AS value, 'm' || CAST(toxic AS VARCHAR) AS model FROM labels WHERE doc_id % 5 <> 0")
def judgement_log(spark, sf_dir):
    from .. import schemas

    row = F.struct(F.concat(F.lit("d"), "doc_id").alias("item_id"), F.col("quality").cast("double").alias("value"), F.struct(F.concat(F.lit("m"), "toxic").alias("model")).alias("judge"))
    lines = t.read(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 5 == 0, F.lit("{")).otherwise(F.to_json(row)).alias("value"))
    return readers.parse_jsonl(lines, schemas.JUDGMENTS, "item_id").select("item_id", "value", F.col("judge.model").alias("model"))


@query("SELECT DISTINCT lower(trim(split_part(p_name, ' ', 1))) AS noun FROM part")
def noun_vocabulary(spark, sf_dir):
    keys = t.read(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit(":")))).alias("key"))
    return readers.noun_vocabulary(keys)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || '|' || p_brand END AS joined FROM part")
def list_literals(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    literal = F.when(F.col("p_partkey") % 7 == 0, F.lit("not a list")).otherwise(F.concat(F.lit("['"), "p_type", F.lit("', '"), "p_brand", F.lit("']")))
    return p.select(F.col("p_partkey").alias("id"), readers.list_literal(literal).alias("l")).select("id", F.size("l").alias("n"), F.array_join("l", "|").alias("joined"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 1 AND abs(CAST(embedding[1] AS DOUBLE) * 20000) <= 1000 AND abs(CAST(embedding[2] AS DOUBLE) * 20000) <= 1000 AND abs(CAST(embedding[3] AS DOUBLE) * 20000) <= 1000")
def bounded_boxes(spark, sf_dir):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 20000)
    boxes = t.read(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, F.when(F.col("vec_id") % 5 == 1, F.lit(2)).otherwise(F.lit(3))).alias("centroid"))
    return readers.bounded_boxes(boxes).select("vec_id")


@query("""SELECT n_regionkey AS env_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, n_nationkey) - 1 AS INTEGER) AS place, n_name AS session_id FROM nation""")
def ordered_sessions(spark, sf_dir):
    session = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("session_id"), (F.col("n_nationkey") % 3).alias("order"))
    envs = t.read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("env_id")).agg(F.sort_array(F.collect_list(session)).alias("sessions"))
    return readers.ordered_sessions(envs).select("env_id", "place", "session.session_id")


@query("SELECT lang AS dataset, count(*) AS n_items, CASE WHEN lang = 'xx' THEN 0 WHEN lang = 'en' THEN (SELECT count(*) FROM documents WHERE lang = 'en') ELSE 1 END AS official, CASE WHEN lang = 'en' OR count(*) = 1 THEN 'yes' ELSE 'no' END AS identical FROM documents GROUP BY lang")
def inventory_verdict(spark, sf_dir):
    counts = t.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n_items"))
    return readers.inventory_verdict(counts.withColumn("official", F.when(F.col("dataset") == "en", F.col("n_items")).otherwise(F.lit(1).cast("long"))))


# --- sinks ------------------------------------------------------------------


@query("SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS value, c_custkey % 3 <> 2 AND c_custkey % 4 = 0 OR c_custkey % 3 <> 0 AND c_custkey % 6 = 1 AS contested FROM customer")
def latched_merge(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "item_id")
    k = F.col("item_id")
    row = lambda tag, keep, mark: c.where(keep).select("item_id", F.lit(tag).alias("value"), mark.alias("contested"))
    return sinks.merge(row("old", k % 3 != 2, k % 4 == 0), row("new", k % 3 != 0, k % 6 == 1), ["item_id"], latch=("contested",))


@query("SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def append_latest(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    old, new = o.where("item_id % 3 = 0").withColumn("status", F.lit("old")), o.where("item_id % 2 = 0").withColumn("status", F.lit("new"))
    return sinks.append_latest(old, new, ["item_id"])


@query("""WITH j AS (SELECT 'r' || (doc_id % 3) AS run_id, 'd' || doc_id AS item_id, 'm' || toxic AS model, 'v' || quality AS prompt_version, CAST(quality AS DOUBLE) AS value FROM labels),
    n AS (SELECT run_id, item_id, model, CASE WHEN item_id LIKE '%1' THEN 'v9' ELSE prompt_version END AS prompt_version, value + 10 AS value FROM j WHERE item_id LIKE '%1' OR item_id LIKE '%2')
    SELECT * FROM n UNION ALL SELECT * FROM j ANTI JOIN n USING (run_id, item_id, model, prompt_version)""")
def judgement_upsert(spark, sf_dir):
    """Judgements are replaced by run, item, model and prompt version: another version adds a row."""
    d = F.concat(F.lit("d"), "doc_id")
    old = t.read(spark, sf_dir, "labels").select(
        F.concat(F.lit("r"), F.col("doc_id") % 3).alias("run_id"), d.alias("item_id"), F.concat(F.lit("m"), "toxic").alias("model"), F.concat(F.lit("v"), "quality").alias("prompt_version"), F.col("quality").cast("double").alias("value"),
    )
    new = old.where("item_id like '%1' or item_id like '%2'").withColumn("prompt_version", F.when(F.col("item_id").endswith("1"), "v9").otherwise(F.col("prompt_version"))).withColumn("value", F.col("value") + 10)
    return sinks.append_latest(old, new, ["run_id", "item_id", "model", "prompt_version"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def cascade_delete(spark, sf_dir):
    kept = t.read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.cascade(t.read(spark, sf_dir, "lineitem"), kept, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


# --- suites, items and runs -------------------------------------------------


@query("SELECT s_suppkey AS env_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')")
def envs_of_items(spark, sf_dir):
    items = t.read(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("env_id"))
    return corpus.envs_of(t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("env_id")), items)


@query("""SELECT d.doc_id AS item_id, d.source AS env_id, CAST(quality AS VARCHAR) AS gold_answer, CAST(n_chars AS DOUBLE) AS gold_answer_numeric, 'chars' AS gold_unit, toxic = 1 AS cross_session, 'a' || (d.doc_id % 4) AS answer
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 3 <> 0""")
def prediction_rows(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").join(t.read(spark, sf_dir, "labels"), "doc_id")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    items = d.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("env_id"), F.col("lang").alias("axis"), F.lit("mcq").alias("answer_format"), F.lit("?").alias("question"), null("map<string,string>", "options"), F.col("quality").cast("string").alias("answer"),
        null("string", "answer_text"), F.struct(F.col("n_chars").cast("double").alias("value"), F.lit("chars").alias("unit")).alias("answer_numeric"), null("array<string>", "aliases"), null("string", "evidence"),
        F.lit(False).alias("is_unanswerable"), null("string", "abstention_option"), F.struct((F.col("toxic") == 1).alias("cross_session")).alias("certificate"),
    )
    answers = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("a"), (F.col("doc_id") % 4).cast("string")).alias("answer"))
    return corpus.prediction_rows(items, answers).select("item_id", "env_id", "gold_answer", "gold_answer_numeric", "gold_unit", "cross_session", "answer")


@query("SELECT count(*) FILTER (b IS NULL) AS n_only_a, count(*) FILTER (a IS NULL) AS n_only_b, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_custkey % 10 <> 7) ON a = b")
def set_completeness(spark, sf_dir):
    a, b = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), t.read(spark, sf_dir, "customer").where("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("k"))
    return corpus.set_difference(a, b, "k")


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus <> 'P'")
def unattempted_items(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "item_id")
    done = t.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    return runs.unattempted(o.select("item_id"), done, o.where("o_orderstatus = 'P'"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE trim('  ' || props || ' ') END AS answer, CASE WHEN event_type = 'view' THEN trim(props) END AS answer_text FROM events")
def parsed_replies(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "open").otherwise("mcq")
    e = t.read(spark, sf_dir, "events").select("event_id", runs.parse_reply(kind, F.concat(F.lit("\t "), "props", F.lit(" \n"))).alias("r"))
    return e.select("event_id", "r.answer", "r.answer_text")


@query("SELECT event_type AS phase, count(*) FILTER (value * 10 > CASE event_type WHEN 'signup' THEN 600 WHEN 'view' THEN 3600 ELSE 300 END) AS n_late, count(*) AS n FROM events GROUP BY 1")
def timeouts(spark, sf_dir):
    phase = F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "view", "ingest").otherwise("query")
    e = t.read(spark, sf_dir, "events").withColumn("late", runs.timed_out(phase, F.col("value") * 10))
    return e.groupBy(F.col("event_type").alias("phase")).agg(F.count_if("late").alias("n_late"), F.count("*").alias("n"))


@query("SELECT doc_id AS query_id, lang AS category FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 25 OFFSET 10")
def query_page(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"))
    return runs.select_queries(rows, "en", 10, 25)


@query("SELECT DISTINCT o_custkey AS candidate, CAST(o_orderkey AS VARCHAR) AS session FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 13 = 0)")
def reachable_candidates(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.col("o_orderkey").cast("string").alias("session"), F.col("o_orderkey").alias("k"))
    return runs.reachable(o.select("candidate", "session"), o.select("session", F.when(F.col("k") % 13 != 0, F.lit(1.0)).alias("size")))


@query("SELECT event_id AS item_id, event_type AS model, value FROM events WHERE user_id = 3 AND event_type = 'click'")
def run_rows(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("item_id"), F.struct(F.col("event_type").alias("model"), F.lit("v1").alias("prompt_version")).alias("judge"), "value")
    return runs.rows_of_run(rows, "3", "click", "v1").select("item_id", F.col("judge.model").alias("model"), "value")


@query("SELECT 'u' || user_id AS run_id, min(ts) AS started_at, count(*) AS n_items FROM events WHERE user_id = 11 GROUP BY 1")
def found_run(spark, sf_dir):
    """One run of the list of all of them."""
    told = t.read(spark, sf_dir, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("run_id")).agg(F.min("ts").alias("started_at"), F.count("*").alias("n_items"))
    return runs.find_run(runs.list_runs(told), "u11")


@query("""WITH m AS (SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE l_partkey % 9 WHEN 0 THEN 'nested/x' ELSE 'f' || (l_partkey % 9) || '.csv' END AS n, l_suppkey % 47 = 3 AS odd, l_tax = 0.05 AS enc,
        CAST(l_quantity AS BIGINT) * 100000 AS size, CASE WHEN l_discount = 0.07 THEN 1000 ELSE 100000 END AS packed FROM lineitem),
    d AS (SELECT *, row_number() OVER (PARTITION BY a, n ORDER BY pos) > 1 AS twice FROM m),
    f AS (SELECT *, CASE WHEN n LIKE '%/%' THEN 'unsafe_name' WHEN odd THEN 'not_a_file' WHEN enc THEN 'encrypted' WHEN twice THEN 'duplicate' END AS flaw, n IN ('f1.csv', 'f2.csv', 'f3.csv', 'f4.csv', 'f5.csv') AND NOT twice AS ours FROM d),
    p AS (SELECT a, count(*) AS c, min_by(flaw, pos) FILTER (flaw IS NOT NULL) AS flaw, bool_or(n = 'f1.csv') AS has, coalesce(sum(size) FILTER (ours), 0) AS total, coalesce(bool_or(ours AND size > greatest(1048576, packed * 1000)), false) AS bomb FROM f GROUP BY 1),
    r AS (SELECT a, total, CASE WHEN c > 6 THEN 'too_many_members' WHEN flaw IS NOT NULL THEN flaw WHEN NOT has THEN 'missing_fields' WHEN total > 6000000 THEN 'over_budget' WHEN bomb THEN 'suspicious_ratio' END AS reason FROM p)
    SELECT a AS archive, reason, CASE WHEN reason IS NULL THEN CAST(total AS BIGINT) ELSE 0 END AS expanded FROM r""")
def archive_verdicts(spark, sf_dir):
    """Orders as archives, their lines as members."""
    k = F.col("l_partkey") % 9
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("archive"), at.alias("at"), F.when(k == 0, "nested/x").otherwise(F.concat(F.lit("f"), k, F.lit(".csv"))).alias("name"), F.when(F.col("l_suppkey") % 47 == 3, 0o120000).otherwise(0o100000).alias("mode"),
        (F.col("l_tax") == 0.05).alias("encrypted"), (F.col("l_quantity").cast("long") * 100_000).alias("size"), F.when(F.col("l_discount") == 0.07, 1000).otherwise(100_000).cast("long").alias("compressed"),
    )
    return archives.verdicts(rows, ["f1.csv"], ["f2.csv", "f3.csv", "f4.csv", "f5.csv"], 6, 6_000_000).select("archive", "reason", "expanded")


@query("SELECT 'exp-' || replace(c_name, '#', '_') || '-' || m AS run_id, m AS mode, CAST(i AS INTEGER) AS batch FROM customer, (VALUES (0, 'memory'), (1, 'blind')) t(i, m)")
def experiment_matrix(spark, sf_dir):
    models = t.read(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("#"), F.lit("_")).alias("id"), F.col("c_custkey").cast("string").alias("gpu"))
    return runs.experiment_matrix(models, "exp", ["memory", "blind"]).select("run_id", "mode", "batch")


class Counter:
    """An adapter that answers with the number of sessions it took in and the last one's name; it fails on each fifth item."""

    def on_env_begin(self, env_id):
        self.seen = []

    def ingest(self, session):
        self.seen.append(session["session_id"])

    def on_ingest_end(self):
        pass

    def answer(self, query):
        if query["n"] % 5 == 0:
            raise ValueError("no answer")
        return f"{len(self.seen)} {self.seen[-1]}"

    def on_env_end(self):
        pass


@query("""WITH s AS (SELECT s_nationkey AS env, count(*) AS n, max_by(s_name, s_suppkey) AS last FROM supplier GROUP BY 1)
    SELECT 'c' || c_custkey AS item_id, CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'no answer' ELSE n || ' ' || last END AS raw FROM customer JOIN s ON c_nationkey = env""")
def adapter_run(spark, sf_dir):
    env = lambda c: F.col(c).cast("string").alias("env_id")
    sessions = t.read(spark, sf_dir, "supplier").select(env("s_nationkey"), F.col("s_name").alias("session_id"), F.col("s_suppkey").alias("order"))
    asked = t.read(spark, sf_dir, "customer").select(env("c_nationkey"), F.concat(F.lit("c"), "c_custkey").alias("item_id"), F.col("c_custkey").alias("n"))
    return runs.run_adapter(Counter, sessions, asked.join(sessions.select("env_id").distinct(), "env_id", "left_semi"))


@query("""WITH r AS (SELECT user_id AS system, event_type AS f, event_id % 40 <> 7 AS good FROM events WHERE event_type <> 'purchase')
    SELECT DISTINCT u.user_id AS system, c.c AS "check", coalesce((SELECT bool_and(r.good) FROM r WHERE r.system = u.user_id AND r.f = c.f), false) AS passed, c.q AS required
    FROM events u, (VALUES ('click', 'mcq5_is_letter', false), ('view', 'mcq_is_letter', true), ('signup', 'open_has_text', true), ('error', 'numeric_has_value', true)) c(f, c, q) WHERE u.event_type <> 'purchase'""")
def reply_conformance(spark, sf_dir):
    kind, good = F.col("event_type"), F.col("event_id") % 40 != 7
    form = F.when(kind == "click", "mcq5").when(kind == "view", "mcq").when(kind == "signup", "open").when(kind == "error", "numeric")
    e = t.read(spark, sf_dir, "events").where("event_type <> 'purchase'")
    replies = e.select(
        F.col("user_id").alias("system"), form.alias("answer_format"), F.when(kind.isin("click", "view"), F.create_map(F.lit("A"), F.lit("sink"), F.lit("B"), F.lit("shelf"))).alias("options"),
        F.when(kind != "signup", F.when(good, F.when(kind == "error", "12").otherwise(" b ")).otherwise(F.when(kind == "error", " ").otherwise("sink"))).alias("answer"), F.when(kind == "signup", F.when(good, "on the shelf").otherwise(" ")).alias("answer_text"),
    )
    return runs.reply_conformance(replies)


@query("""WITH w AS (SELECT event_id, 'i' || user_id AS item, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'answer' WHEN 'signup' THEN 'ingest' WHEN 'purchase' THEN 'ingest_ack' ELSE 'unknown_ok' END AS kind FROM events),
    s AS (SELECT *, count(*) FILTER (kind = 'query') OVER (PARTITION BY item ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS asked FROM w),
    c AS (SELECT min_by(kind, event_id) = 'ready' AS handshake, count(*) FILTER (kind = 'ingest_ack') >= count(*) FILTER (kind = 'ingest') AS acks, count(*) FILTER (kind = 'answer' AND NOT asked) = 0 AS echoes,
        count(*) FILTER (kind = 'answer') = count(*) FILTER (kind = 'query') AS answers, count(*) FILTER (kind = 'unknown_ok') > 0 AS ignores FROM s)
    SELECT handshake::BIGINT + acks::BIGINT + echoes::BIGINT + answers::BIGINT + ignores::BIGINT AS passed, 4 - (handshake::BIGINT + acks::BIGINT + echoes::BIGINT + answers::BIGINT) AS failed_required, 1 - ignores::BIGINT AS failed_advisory FROM c""")
def conformance_summary(spark, sf_dir):
    names = ("view", "query", "click", "answer", "signup", "ingest", "purchase", "ingest_ack", "error", "unknown_ok")
    log = t.read(spark, sf_dir, "events").select(F.concat(F.lit("i"), "user_id").alias("item_id"), F.create_map(*map(F.lit, names))[F.col("event_type")].alias("type"), F.col("event_id").alias("seq"))
    return recordings.conformance_summary(runs.conformance(log))


@query("SELECT event_type AS status, count(*) FILTER (event_id % 4 <> 0) AS n, count(*) FILTER (event_id % 4 = 0) AS n_outside FROM events GROUP BY 1")
def live_snapshot(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("status"))
    return live.snapshot(e, e.where("item_id % 4 <> 0"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_row(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return events.latest_row(e, "user_id", "at").select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {t.SCORES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (status = 'ok' AND NOT needs_judge AND abstained) AS ab, count(*) FILTER (status = 'ok' AND NOT needs_judge AND NOT abstained AND score >= 0.5) AS ok,
        count(*) FILTER (status = 'ok' AND NOT needs_judge AND NOT abstained) AS done, count(*) FILTER (status = 'ok' AND NOT needs_judge AND score < 0.5) AS a, count(*) FILTER (status = 'ok' AND NOT needs_judge AND score >= 0.5) AS b FROM scores)
    SELECT a AS n_a, b AS n_b, round(ok / n, 9) AS mean, round((ok + ab * 0.25::DOUBLE) / n, 9) AS naive_mean, round(ok / done, 9) AS rate FROM c""")
def shortcut_letters(spark, sf_dir):
    rows = t.scores(spark, sf_dir).withColumn("letter", F.when(~F.col("needs_judge"), F.when(F.col("score") >= 0.5, "B").otherwise("A"))).withColumn("gold", F.lit("B"))
    out = report.shortcut_report(rows, 0.25)
    return out.select(F.col("letters")["A"].alias("n_a"), F.col("letters")["B"].alias("n_b"), *(F.round(c, 9).alias(c) for c in ("mean", "naive_mean", "rate")))


@query(f"""WITH {t.SCORES_SQL}, c AS (SELECT count(*) FILTER (done AND score >= 0.5) AS k, count(*) FILTER (done) AS n FROM (SELECT *, status = 'ok' AND NOT needs_judge AND NOT abstained AS done FROM scores)),
    i AS (SELECT n, k, unnest(range(0, n + 1)) AS i FROM c), p AS (SELECT n, k, i, lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.7) + (n - i) * ln(0.3) AS l FROM i),
    s AS (SELECT *, (SELECT l FROM p WHERE i = k) AS seen FROM p), w AS (SELECT n, k, k / n AS r, 1.959963984540054 AS z FROM c)
    SELECT round(least(1.0, (SELECT sum(exp(l)) FROM s WHERE l <= seen + 1e-9)), 6) AS p_value, round((r + z * z / (2 * n) - z * sqrt(r * (1 - r) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 9) AS rate_low,
        round((r + z * z / (2 * n) + z * sqrt(r * (1 - r) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 9) AS rate_high FROM w""")
def shortcut_test(spark, sf_dir):
    """The test of a blind run's commitments against a share of 0.7 that a guesser would reach."""
    rows = t.scores(spark, sf_dir).withColumn("letter", F.when(~F.col("needs_judge"), F.when(F.col("score") >= 0.5, "B").otherwise("A"))).withColumn("gold", F.lit("B"))
    out = report.shortcut_report(rows, 0.7)
    return out.select(F.round("p_value", 6).alias("p_value"), F.round("rate_low", 9).alias("rate_low"), F.round("rate_high", 9).alias("rate_high"))


@query("""SELECT event_type AS arm, count(*) FILTER (event_id % 3 <> 0) AS video_probes, count(*) FILTER (event_id % 3 = 1) AS repeated, count(*) FILTER (event_id % 3 = 1 AND event_id % 2 = 0) AS free_repeated,
    count(*) FILTER (event_id % 3 = 1 AND event_id % 2 = 1) AS template_repeated, count(*) FILTER (event_id % 3 = 2) AS refusal_text, count(*) FILTER (event_id % 6 = 0) AS controls_correct, count(*) FILTER (event_id % 3 = 0) AS n_controls FROM events GROUP BY 1""")
def arm_outcomes(spark, sf_dir):
    v = F.col("event_id")
    answer = F.when(v % 3 == 1, F.repeat(F.lit("again "), F.lit(30))).when(v % 3 == 2, "I cannot see this.").when(v % 6 == 0, " 42 ").otherwise("41")
    probes = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), answer.alias("answer"), F.when(v % 3 == 0, "42").alias("expected_control"), "event_id")
    return report.arm_outcomes(probes, v % 2 == 1)


# --- planning and recordings ------------------------------------------------


@query("SELECT CASE WHEN l_shipdate IS NULL THEN 'x' ELSE l_linestatus END AS dataset, count(*) AS n_files, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS missing_bytes FROM lineitem GROUP BY 1")
def download_budget(spark, sf_dir):
    files = t.read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("dataset"), (F.col("l_returnflag") == "R").alias("present"), F.col("l_quantity").cast("long").alias("expected_bytes"))
    return recordings.download_budget(files)


@query("""SELECT user_id, CASE WHEN sum(event_id) > 100000 THEN 'over_budget' WHEN sum(event_id) + 50000 > 120000 THEN 'no_space' ELSE 'ok' END AS verdict FROM events GROUP BY 1""")
def download_verdict(spark, sf_dir):
    budgets = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("missing_bytes"))
    return recordings.download_verdict(budgets, 100_000, 120_000, 50_000).select("user_id", "verdict")


@query("SELECT c_name AS path, c_custkey + 1 AS size, sha256(c_name) AS sha256 FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def official_files(spark, sf_dir):
    c = t.read(spark, sf_dir, "customer")
    planned = c.join(t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_name").alias("path"))
    return recordings.official_files(planned, c.select(F.col("c_name").alias("path"), (F.col("c_custkey") + 1).alias("size"), F.sha2("c_name", 256).alias("sha256")))


@query("""WITH i AS (SELECT o_custkey AS s, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'human' ELSE 'object' END AS kind, CASE o_orderpriority WHEN '1-URGENT' THEN 'dynamic' WHEN '5-LOW' THEN NULL ELSE 'static' END AS motion FROM orders),
    d AS (SELECT s, count(*) FILTER (kind = 'object' AND motion = 'dynamic') AS n FROM i GROUP BY 1)
    SELECT 'instance_type' AS histogram, kind AS key, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'motion_type', coalesce(motion, 'missing'), count(*) FROM i WHERE kind = 'object' GROUP BY 2
    UNION ALL SELECT 'unique_dynamic', '', count(DISTINCT k) FROM i WHERE kind = 'object' AND motion = 'dynamic' UNION ALL SELECT 'dynamic_per_sequence', CAST(n AS VARCHAR), count(*) FROM d GROUP BY 2""")
def instance_histograms(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders")
    motion = F.when(F.col("o_orderpriority") == "1-URGENT", "dynamic").when(F.col("o_orderpriority") != "5-LOW", "static")
    return recordings.instance_histograms(o.select(F.col("o_custkey").alias("sequence"), F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") == "P", "human").otherwise("object").alias("instance_type"), motion.alias("motion_type")))


@query("SELECT l_suppkey % 50 AS digest, min(l_orderkey * 10 + l_linenumber) AS clip, count(*) OVER () AS n FROM lineitem GROUP BY 1")
def first_clips(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("digest"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip"))
    first = recordings.first_clips(rows, "digest", "clip")
    return first.crossJoin(first.agg(F.count("*").alias("n")))  # one row


@query("""WITH v AS (SELECT n_nationkey AS k, 'VIDEO ' || n_nationkey || ' id=' || n_name || ' weekday=day' || (n_nationkey % 7) || chr(10) || 'SCENE 1 time_of_day=noon place=' || n_regionkey || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE chr(10) || 'CAPTION: in ' || lower(n_name) END AS said FROM nation),
    c AS (SELECT DISTINCT CASE WHEN user_id % 26 = 25 THEN -1 ELSE user_id % 26 END AS cutoff FROM events)
    SELECT cutoff, string_agg(said, chr(10) ORDER BY k) AS context, count(k) AS n_videos, count(k) AS n_segments FROM c JOIN v ON cutoff = -1 OR k <= cutoff GROUP BY 1""")
def caption_context(spark, sf_dir):
    k = F.col("n_nationkey")
    scene = F.struct(
        F.lit(1).alias("scene_id"), F.lit("noon").alias("time_of_day"), F.col("n_regionkey").alias("place"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("in "), F.lower("n_name"))).alias("activity_summary"),
    )
    videos = t.read(spark, sf_dir, "nation").select(k.alias("video_idx"), F.col("n_name").alias("video_id"), F.concat(F.lit("day"), k % 7).alias("time_of_week"), F.array(scene).alias("segments"))
    u = F.col("user_id") % 26
    cutoffs = t.read(spark, sf_dir, "events").select(F.when(u == 25, F.lit(-1).cast("long")).otherwise(u).alias("cutoff"))
    return recordings.caption_context(videos, cutoffs)


_REASON = """CASE WHEN k % 11 = 0 THEN 'invalid_source_row' WHEN k % 13 = 0 THEN 'unanswerable_not_in_visual_pilot' WHEN k % 17 = 0 THEN 'missing_evidence' WHEN k % 19 = 0 THEN 'requires_nonvisual_or_unknown_modality'
    WHEN k % 23 = 0 THEN 'ambiguous_query_recording' WHEN NOT (c > 0 AND c <= 1200) THEN 'query_prefix_outside_budget' WHEN i = 7 OR j = 7 THEN 'unknown_or_conflicting_recording_time'
    WHEN 10000 * j + e > 10000 * i + c THEN 'answer_evidence_after_query_boundary'"""


@query(f"""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 40 AS i, CASE WHEN o_orderkey % 6 = 0 THEN (o_orderkey + 38) % 40 WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 39) % 40 ELSE o_orderkey % 40 END AS j, o_orderkey % 1500 AS c, o_orderkey % 1700 + 1 AS e FROM orders),
    h AS (SELECT *, list_sort(list_filter([i, (i + 3) % 40, (i + 39) % 40], lambda x: x <> 7 AND 10000 * x < 10000 * i + c)) AS seen, list_contains([i, (i + 3) % 40, (i + 39) % 40], 7) AS unknown FROM q)
    SELECT k AS question_id, {_REASON} WHEN j <> i THEN 'requires_cross_session_context' END AS reason,
        {_REASON} WHEN unknown THEN 'history_has_unknown_recording_times' WHEN NOT list_contains(seen, j) THEN 'evidence_not_in_official_history' END AS reason_history,
        CASE WHEN i <> 7 THEN array_to_string(list_transform(seen, lambda x: 'Person_' || x || '_session_1_a'), ',') ELSE '' END AS history FROM h""")
def eligible_questions(spark, sf_dir):
    """Questions of forty recordings, one of which has two starts: the rules without and with the recordings before the question."""
    k = F.col("o_orderkey")
    i, c = k % 40, (k % 1500).cast("double")
    j = F.when(k % 6 == 0, (k + 38) % 40).when(k % 3 == 0, (k + 39) % 40).otherwise(i)
    name = lambda x: F.concat(F.lit("Person_"), x.cast("string"), F.lit("_session_1_a"))
    modes = lambda odd: F.when(odd, F.array(F.lit("Audio"))).otherwise(F.array(F.lit("Video"), F.lit("OCR")))
    time_span = F.struct(F.lit(0.0).alias("start_time"), (k % 1700 + 1).cast("double").alias("end_time"))
    evidence = F.array(F.struct(name(j).alias("video_id"), F.when(j != 7, (j * 10000).cast("double")).alias("start_time"), time_span.alias("time_span"), modes(k % 19 == 0).alias("modalities")))
    span = F.array(F.struct(c.alias("start_time"), (c + 5).alias("end_time"), F.when(k % 23 == 0, name((k + 5) % 40)).alias("video_id")))
    choices = F.array(F.lit("shelf"), F.lit("sink"), F.lit(recordings.UNANSWERABLE_CHOICE), F.lit("drawer"))
    qa = t.read(spark, sf_dir, "orders").select(
        k.alias("question_id"), F.struct(name(i).alias("primary_video_id"), (i * 10000 + F.when(i == 7, F.floor(k / 40) % 2).otherwise(0)).cast("double").alias("primary_video_start_time")).alias("metadata"),
        F.struct(F.when(k % 17 == 0, F.slice(evidence, 1, 0)).otherwise(evidence).alias("evidence_list")).alias("answer_evidence"),
        F.struct(span.alias("time_spans"), name(i).alias("video_id"), modes(F.lit(False)).alias("modalities")).alias("question_evidence"),
        F.when(k % 11 == 0, F.slice(choices, 1, 3)).otherwise(choices).alias("choices"), F.array(*map(F.lit, ("wrong", "correct", "wrong", "wrong"))).alias("choice_types"),
        F.lit(1).alias("correct_option_index"), F.lit("sink").alias("correct_answer"), (k % 13 != 0).alias("is_answerable"), F.array(name((k + 3) % 40), name((k + 39) % 40)).alias("video_ids"),
    )
    alone = recordings.eligibility(qa).select("question_id", "reason")
    told = recordings.eligibility(qa, history=True).select("question_id", F.col("reason").alias("reason_history"), F.array_join("recordings", ",").alias("history"))
    return alone.join(told, "question_id")


@query("""WITH r AS (SELECT user_id AS u, count(*) AS n, bool_or(event_type = 'error' AND user_id % 5 = 0) AS bad FROM events GROUP BY 1)
    SELECT CAST(u AS VARCHAR) AS run_id, bad OR u % 17 = 3 OR u % 19 = 4 AND u % 2 = 0 OR u % 29 = 5 OR u % 31 = 6 OR u % 37 = 7 AND u % 2 = 0 OR u % 41 = 8 OR u % 23 = 9 AS failed FROM r""")
def run_health_conditions(spark, sf_dir):
    """Each of the eight conditions fails some runs: exit code, status, frames, sessions, latch, memory, mode and item set."""
    u = F.col("user_id")
    e = t.read(spark, sf_dir, "events").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    flag = lambda on: F.when(on, 1).otherwise(0)
    rows = e.select(
        u.cast("string").alias("run_id"), F.col("event_id").cast("string").alias("item_id"), (F.col("n") + flag(u % 23 == 9)).alias("n_expected"), flag(u % 17 == 3).alias("exit_code"),
        F.when((F.col("event_type") == "error") & (u % 5 == 0), "error").otherwise("ok").alias("status"), F.when(u % 19 == 4, 0).otherwise(9).alias("total_frames"), flag(u % 29 == 5).alias("sessions_without_frames"),
        (u % 31 == 6).alias("revocation_contested"), flag(u % 37 != 7).alias("n_records"), flag(u % 37 != 7).alias("memory_bytes"), F.when(u % 2 == 0, "memory").otherwise("blind").alias("context_mode"),
        F.when((u % 2 == 0) != (u % 41 == 8), "memory").otherwise("blind").alias("expected_mode"),
    )
    return runs.run_health(rows)


_SAID = """'VIDEO ' || doc_id || ' id=' || source || ' weekday=' || lang || chr(10) || 'SCENE 1 time_of_day=noon place=' || lang || CASE WHEN trim(text) <> '' THEN chr(10) || 'CAPTION: ' || trim(text) ELSE '' END"""


@query(f"""WITH v AS (SELECT doc_id AS v, length({_SAID}) + 1 AS l FROM documents), c AS (SELECT DISTINCT CASE WHEN doc_id % 100 = 7 THEN -1 ELSE doc_id * 2 END AS cutoff FROM labels),
    r AS (SELECT v, count(*) OVER w AS n, CAST(sum(l) OVER w AS BIGINT) AS l FROM v WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), e AS (SELECT cutoff, CASE WHEN cutoff = -1 THEN 9000000000 ELSE cutoff END AS at FROM c)
    SELECT cutoff, coalesce(n, 0) AS n_videos, coalesce(n, 0) AS n_segments, greatest(coalesce(l, 0) - 1, 0) AS n_chars FROM e ASOF LEFT JOIN r ON e.at >= r.v""")
def caption_prefixes(spark, sf_dir):
    scene = F.struct(F.lit(1).alias("scene_id"), F.lit("noon").alias("time_of_day"), F.col("lang").alias("place"), F.col("text").alias("activity_summary"))
    videos = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_idx"), F.col("source").alias("video_id"), F.col("lang").alias("time_of_week"), F.array(scene).alias("segments"))
    d = F.col("doc_id")
    cutoffs = t.read(spark, sf_dir, "labels").select(F.when(d % 100 == 7, F.lit(-1).cast("long")).otherwise(d * 2).alias("cutoff"))
    return recordings.caption_prefixes(recordings.caption_texts(videos), cutoffs, range_rows=2000)


_PHASES = {"signup": "query", "view": "ingest", "click": "ready", "purchase": "answer", "error": "ingest_ack"}


@query("""WITH l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'query' WHEN 'view' THEN 'ingest' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'ingest_ack' ELSE 'ready' END AS k FROM events),
    n AS (SELECT *, lead(CASE WHEN k IN ('answer', 'query', 'ingest') THEN ts END IGNORE NULLS) OVER w AS q, lead(CASE WHEN k IN ('ingest_ack', 'query', 'ingest') THEN ts END IGNORE NULLS) OVER w AS i FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT user_id, event_id, CASE k WHEN 'query' THEN 'answer' ELSE 'ingest_ack' END AS phase, CASE k WHEN 'query' THEN ts + INTERVAL 300 SECOND ELSE ts + INTERVAL 3600 SECOND END AS deadline, CASE k WHEN 'query' THEN q ELSE i END AS over FROM n WHERE k IN ('query', 'ingest'))
    SELECT 'u' || user_id AS env_id, event_id AS seq, phase, epoch_us(deadline) AS deadline FROM d WHERE coalesce(over > deadline, true) AND deadline < (SELECT max(ts) FROM events)""")
def phase_timeouts(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for kv in _PHASES.items() for x in kv))[F.col("event_type")]
    log = t.read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("env_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("type"))
    return sessions.phase_timeouts(log).withColumn("deadline", F.unix_micros("deadline"))


@query("""WITH l AS (SELECT user_id AS s, event_id AS seq, event_type AS e, event_id % 6 AS id, event_id % 5 AS k FROM events),
    f AS (SELECT s, min_by(e, seq) IN ('signup', 'view') AS hs, min_by(k, seq) AS mode FROM l GROUP BY 1),
    a AS (SELECT s, id, min(seq) FILTER (e = 'click') AS asked, max(seq) FILTER (e = 'purchase') AS said FROM l GROUP BY 1, 2),
    q AS (SELECT s, count(*) FILTER (asked IS NOT NULL AND NOT coalesce(said > asked, false)) AS open, count(*) FILTER (asked IS NULL AND said IS NOT NULL) AS strange FROM a GROUP BY 1),
    u AS (SELECT s, max(seq) > max(seq) FILTER (e = 'error') AS alive FROM l GROUP BY 1),
    c AS (SELECT s, hs, [{'n': 'handshake', 'p': hs, 'r': true, 'd': true}, {'n': 'declares_context_mode', 'p': mode <> 4, 'r': true, 'd': hs}, {'n': 'specific_system_id', 'p': mode <> 3, 'r': false, 'd': hs}, {'n': 'ingest_acknowledged', 'p': true, 'r': true, 'd': hs},
        {'n': 'ingest_end_acknowledged', 'p': false, 'r': true, 'd': hs}, {'n': 'releases_media', 'p': mode <> 0 OR s % 3 <> 0, 'r': true, 'd': hs}, {'n': 'answers_all', 'p': open = 0, 'r': true, 'd': hs}, {'n': 'echoes_ids', 'p': strange = 0, 'r': true, 'd': hs},
        {'n': 'accepts_env_end', 'p': false, 'r': true, 'd': hs}, {'n': 'survives_unknown', 'p': coalesce(alive, false), 'r': false, 'd': hs}] AS c FROM f JOIN q USING (s) JOIN u USING (s)),
    x AS (SELECT s, unnest(c) AS c FROM c)
    SELECT CAST(s AS VARCHAR) AS system, c.n AS "check", c.p AS passed, c.r AS required FROM x WHERE c.d""")
def exchange_conformance(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("event_id") % 5
    said = F.when(kind.isin("signup", "view"), "ready").when(kind == "click", "query").when(kind == "purchase", "answer").otherwise("unknown")
    mode = F.when(k == 0, "memory").when(k == 1, "oracle").when(k == 4, "other").otherwise("blind")
    log = t.read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("system"), F.col("event_id").alias("seq"), said.alias("type"), F.when(k == 3, " System ").otherwise("model-1").alias("system_id"),
        mode.alias("context_mode"), F.lit(None).cast("string").alias("session_id"), (F.col("event_id") % 6).cast("string").alias("item_id"),
    )
    held = log.where("cast(system as int) % 3 = 0").select("system", F.lit("/stage/a.mp4").alias("path")).distinct()
    return runs.exchange_conformance(log, held)


# --- mining and scans -------------------------------------------------------

_PLACED = ["table", "Wall", "floor", "lamp", "STAIRS"]
_LABEL_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'Wall' WHEN 2 THEN 'floor' WHEN 3 THEN 'lamp' ELSE 'STAIRS' END"


def _part(spark, sf_dir):
    return t.read(spark, sf_dir, "part").withColumn("label", F.element_at(F.array(*map(F.lit, _PLACED)), (F.col("p_partkey") % 5 + 1).cast("int")))


@query(f"SELECT p_partkey AS id, {_LABEL_SQL} AS label FROM part WHERE p_partkey % 5 IN (0, 3) AND p_size >= 20")
def moved_objects(spark, sf_dir):
    moves = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), "label", F.col("p_size").cast("double").alias("displacement"))
    return mining.moved_objects(moves, 20.0).select("id", "label")


@query(f"SELECT label, count(*) AS n, CASE WHEN label = 'lamp' OR label = 'table' OR label = 'STAIRS' THEN 'a ' ELSE 'an ' END || label AS said FROM (SELECT {_LABEL_SQL} AS label FROM part WHERE p_partkey % 5 IN (0, 3, 4)) GROUP BY 1 UNION ALL SELECT 'Apple', count(*), 'an Apple' FROM part WHERE p_partkey % 5 = 1 HAVING count(*) > 0")
def usable_labels(spark, sf_dir):
    named = _part(spark, sf_dir).select(F.when((F.col("label") == "Wall") & (F.col("p_partkey") % 5 == 1), "Apple").otherwise(F.col("label")).alias("label"))
    return named.where(mining.usable(F.col("label"))).groupBy("label").agg(F.count("*").alias("n")).withColumn("said", F.concat(mining.article(F.col("label")), F.lit(" "), "label"))


@query("SELECT s_suppkey AS scan, CASE s_suppkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'Standing On' WHEN 2 THEN 'inside' ELSE 'bigger than' END AS predicate, s_suppkey % 4 IN (1, 2) AS near FROM supplier WHERE s_suppkey % 4 <> 3")
def spatial_relations(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = t.read(spark, sf_dir, "supplier").select(k.alias("scan"), F.when(k % 4 == 0, "left").when(k % 4 == 1, "Standing On").when(k % 4 == 2, "inside").otherwise("bigger than").alias("predicate"))
    near = mining.relations(rows, proximity_only=True).select("scan", F.lit(True).alias("near"))
    return mining.relations(rows).join(near, "scan", "left").withColumn("near", F.coalesce("near", F.lit(False)))


@query("SELECT l_orderkey AS scan, p1.p_name AS subject_label, p2.p_name AS object_label FROM lineitem JOIN part p1 ON l_partkey = p1.p_partkey JOIN part p2 ON (l_partkey + 1) = p2.p_partkey WHERE p1.p_size > 5 AND p2.p_size > 5")
def named_relations(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("subject"), (F.col("l_partkey") + 1).alias("object"))
    seen = rows.select("scan", F.explode(F.array("subject", "object")).alias("instance")).distinct()
    labels = seen.join(t.read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("instance"), F.col("p_name").alias("label")), "instance")
    return scans.named_relations(rows, labels).select("scan", "subject_label", "object_label")


def _rooms(spark, sf_dir):
    """Customers as rooms: their orders as later scans, the lines of these as moves (null transforms where a line was returned late)."""
    o, li = t.read(spark, sf_dir, "orders"), t.read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    transform = F.when(F.col("l_linenumber") < 7, F.concat(F.array_repeat(F.lit(0.0), 12), F.array(q, F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    moves = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct((F.col("l_partkey") % 1000).cast("int").alias("instance_reference"), transform.alias("transform")))).alias("rigid"))
    later = o.join(moves, o.o_orderkey == moves.l_orderkey, "left").select("o_custkey", F.struct(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("reference"), "rigid", F.array((F.col("o_orderkey") % 1000).cast("int")).alias("removed")).alias("s"))
    return later.groupBy("o_custkey").agg(F.sort_array(F.collect_list("s")).alias("scans")).select(F.col("o_custkey").cast("string").alias("reference"), F.when(F.col("o_custkey") % 3 == 0, "test").otherwise("train").alias("type"), "scans")


@query("""WITH m AS (SELECT o_custkey, max(l_linenumber) >= 7 AS withheld FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), n AS (SELECT o_custkey, count(*) + 1 AS n FROM orders GROUP BY 1)
    SELECT CAST(o_custkey AS VARCHAR) AS reference, CAST(n AS INTEGER) AS n_sessions FROM n LEFT JOIN m USING (o_custkey) WHERE NOT coalesce(withheld, false) AND n >= 4 AND o_custkey % 3 <> 0""")
def multi_session_rooms(spark, sf_dir):
    return scans.multi_session(scans.environments(_rooms(spark, sf_dir)), 4).select("reference", "n_sessions")


@query("SELECT CAST(o_custkey AS VARCHAR) AS reference, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS scan, CAST(l_partkey % 1000 AS INTEGER) AS instance, l_quantity AS displacement FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < 7")
def scan_moves(spark, sf_dir):
    return readers.scan_moves(_rooms(spark, sf_dir))


@query("""WITH m AS (SELECT l_quantity AS d, p_name AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey % 1000 WHERE l_linenumber < 7)
    SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS environments, (SELECT count(*) + count(DISTINCT o_custkey) FROM orders) AS scans, (SELECT count(*) FROM m) AS moves, (SELECT count(*) FROM m) AS loose_moves,
        (SELECT list_sort(list(d))[count(*) // 2 + 1] FROM m) AS median_displacement""")
def scan_summary(spark, sf_dir):
    rooms = _rooms(spark, sf_dir)
    moves = readers.scan_moves(rooms)
    named = t.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("instance"), F.col("p_name").alias("label"))
    labels = moves.select(F.col("reference").alias("scan"), "instance").distinct().join(named, "instance")
    return scans.summary(scans.environments(rooms), scans.named_moves(moves, labels))


@query("""WITH s AS (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS scan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT scan, CAST(i AS INTEGER) AS index, 'In room ' || substr(CAST(o_custkey AS VARCHAR), 1, 8) || ', the chair was moved between scans. Which object was it closest to ' || CASE WHEN n = 1 THEN 'in the later scan' ELSE 'in scan ' || i || ' of the ' || n || ' taken afterwards' END || '?' AS question FROM s""")
def scan_questions(spark, sf_dir):
    placed = scans.scan_index(_rooms(spark, sf_dir))
    return placed.select("scan", "index", scans.question(F.col("reference"), F.lit("Chair"), F.col("index"), F.col("n_rescans")).alias("question"))


@query("""WITH b AS (SELECT o_custkey AS env, p_name AS subject, max(l_quantity * 1000000 - (l_orderkey * 7 + l_linenumber) % 1000000) AS best FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT CAST(env AS VARCHAR) AS env_id, subject, best AS displacement FROM b QUALIFY row_number() OVER (PARTITION BY env ORDER BY best DESC, subject) <= 4""")
def mined_moves(spark, sf_dir):
    li, o, p = (t.read(spark, sf_dir, name) for name in ("lineitem", "orders", "part"))
    size = F.col("l_quantity") * 1000000 - (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000000
    sized = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", size.cast("double").alias("displacement"))
    rows = sized.join(p, F.col("l_partkey") == F.col("p_partkey"))
    built = rows.select(F.col("o_custkey").cast("string").alias("env_id"), F.col("p_name").alias("ord"), F.lit(1).alias("scan"), F.col("p_name").alias("subject"), F.lit("sofa").alias("gold"), "displacement")
    return mining.mine_environment(built).select("env_id", "subject", "displacement")


def _walk(cap: int) -> str:
    """The sequential walk in SQL: each step asks the best move of each environment that no earlier step blocks."""
    blocked = "SELECT 1 FROM t{0} t WHERE t.env_id = m.env_id AND (t.subject = m.subject OR t.scan = m.scan AND t.subject = m.gold AND t.gold = m.subject)"
    steps = ["t0 AS (SELECT * FROM m WHERE false)"]
    for k in range(1, cap + 1):
        steps.append(f"t{k} AS (SELECT * FROM t{k - 1} UNION ALL SELECT * FROM (SELECT * FROM m WHERE NOT EXISTS ({blocked.format(k - 1)}) QUALIFY row_number() OVER (PARTITION BY env_id ORDER BY displacement DESC, ord) = 1))")
    return ", ".join(steps)


@query(f"""WITH m AS (SELECT CAST(o_custkey % 60 AS VARCHAR) AS env_id, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord,
        CAST(l_linenumber % 2 AS INTEGER) AS scan, 'thing' || (l_partkey % 6) AS subject, 'thing' || (l_suppkey % 6) AS gold, CAST(l_quantity AS DOUBLE) AS displacement
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 6 <> 0 AND l_suppkey % 6 <> 0), {_walk(4)}
    SELECT env_id, ord, scan, subject, gold, displacement FROM t4""")
def mined_mirrors(spark, sf_dir):
    """Moves between six labels in two scans of each environment, so that many are mirrors; one label is unusable."""
    label = lambda c: F.when(F.col(c) % 6 == 0, "wall").otherwise(F.concat(F.lit("thing"), F.col(c) % 6))
    li, o = t.read(spark, sf_dir, "lineitem"), t.read(spark, sf_dir, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    usable = li.where("l_partkey % 6 <> 0 and l_suppkey % 6 <> 0").withColumn("ord", F.col("l_orderkey") * 100 + F.row_number().over(order))
    other = li.where("l_partkey % 6 = 0 or l_suppkey % 6 = 0").withColumn("ord", -F.col("l_orderkey"))
    rows = usable.unionByName(other).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    built = rows.select((F.col("o_custkey") % 60).cast("string").alias("env_id"), "ord", (F.col("l_linenumber") % 2).cast("int").alias("scan"), label("l_partkey").alias("subject"), label("l_suppkey").alias("gold"), F.col("l_quantity").cast("double").alias("displacement"))
    return mining.mine_environment(built)


@query("""WITH p AS (SELECT user_id, event_id, event_type AS noun, CASE event_id % 3 WHEN 0 THEN 'drawer' WHEN 1 THEN 'fridge' END AS head FROM events WHERE event_type <> 'view')
    SELECT CAST(user_id AS VARCHAR) AS participant_id, noun AS object, count(DISTINCT head) AS n_places, CAST(count(DISTINCT event_id % 7) AS INTEGER) AS n_sessions FROM p WHERE head IS NOT NULL GROUP BY ALL HAVING n_places >= 2""")
def placement_candidates(spark, sf_dir):
    v = F.col("event_id")
    where = F.when(v % 3 == 0, "in the top drawer").when(v % 3 == 1, "in fridge").otherwise("away")
    rows = t.read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("participant_id"), (v % 7).cast("string").alias("video_id"), v.cast("string").alias("narration_id"), F.concat(F.lit("put "), "event_type", F.lit(" "), where).alias("narration"),
        F.when(F.col("event_type") == "view", "wash").otherwise("put").alias("verb"), F.col("event_type").alias("noun"), F.lit("0").alias("start_timestamp"),
    )
    return mining.candidate_rows(mining.placements(rows)).select("participant_id", "object", "n_places", "n_sessions")


@query("""WITH o AS (SELECT DISTINCT event_id, unnest([event_type, 'k' || (event_id % 30), 'k' || (event_id % 7)]) AS noun, event_type AS own FROM events) SELECT noun, count(*) AS count FROM o WHERE noun <> own GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def second_nouns(spark, sf_dir):
    n = lambda m: F.concat(F.lit("k"), (F.col("event_id") % m).cast("string"))
    return mining.second_nouns(t.read(spark, sf_dir, "events").withColumn("nouns", F.array("event_type", n(30), n(7))), "nouns", "event_type")


_SURVEY_SQL = """c AS (SELECT o_custkey AS p, l_partkey % 40 AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_orderkey) >= 2),
    s AS (SELECT o_custkey AS participant, count(*) AS n_sessions, (SELECT count(*) FROM c WHERE c.p = o_custkey) AS n_cross FROM orders GROUP BY 1)"""


def _survey(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("participant"), F.col("o_orderkey").alias("session"))
    li = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_partkey") % 40).alias("object"), F.col("l_suppkey").alias("place"))
    return mining.relocation_survey(o.join(li, "session"), o)


@query(f"WITH {_SURVEY_SQL} SELECT * FROM s")
def relocation_survey(spark, sf_dir):
    return _survey(spark, sf_dir)


@query(f"WITH {_SURVEY_SQL} SELECT count(*) AS participants, quantile_cont(n_sessions, 0.5) AS median_sessions, max(n_sessions) AS max_sessions, CAST(sum(n_cross) AS BIGINT) AS n_cross FROM s")
def survey_totals(spark, sf_dir):
    return mining.survey_totals(_survey(spark, sf_dir))


# --- identifiers, numbers and times -----------------------------------------


@query("""WITH v AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Person_' || c_custkey || '_session_2_a1' WHEN 1 THEN 'P' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '_' || c_custkey WHEN 2 THEN 'Person_x_session_1_a' ELSE c_name END AS v FROM customer)
    SELECT k, k % 4 = 0 AS recording, k % 4 = 1 AND k >= 100 AS extension, CASE WHEN k % 4 = 0 THEN 'data/video/Person_' || k || '/' || v || '.mp4' END AS path,
        CASE WHEN k % 4 = 1 AND k >= 100 THEN 'ext/' || split_part(v, '_', 1) || '/videos/' || v || '.MP4' ELSE 'old/videos/train/' || split_part(v, '_', 1) || '/' || v || '.MP4' END AS url, k % 4 <> 3 AS safe FROM v""")
def recording_ids(spark, sf_dir):
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("Person_"), k, F.lit("_session_2_a1"))).when(k % 4 == 1, F.concat(F.lit("P"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("_"), k)).when(k % 4 == 2, "Person_x_session_1_a").otherwise(F.col("c_name"))
    rows = t.read(spark, sf_dir, "customer").select(k.alias("k"), v.alias("v"))
    c = F.col("v")
    return rows.select("k", ids.valid_video_id(c).alias("recording"), ids.is_extension_video(c).alias("extension"), ids.video_path(c).alias("path"), F.element_at(ids.video_urls(c, "old", "ext"), 1).alias("url"), ids.valid_name(c).alias("safe"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE value END AS start, event_id % 5 > 1 AND event_id % 2 = 0 AS ok FROM events WHERE value IS NOT NULL AND value >= 0""")
def time_windows(spark, sf_dir):
    v = F.col("event_id")
    start = F.when(v % 5 == 0, "Infinity").when(v % 5 == 1, "-1").otherwise(F.col("value").cast("string"))
    end = F.when(v % 2 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return t.read(spark, sf_dir, "events").where("value >= 0").select("event_id", ids.seconds(start).alias("start"), ids.valid_window(start, end).alias("ok"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) ELSE '' END AS object, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS session FROM part""")
def parsed_questions(spark, sf_dir):
    k = F.col("p_partkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit("Where was the "), "p_name", F.when(k % 6 == 3, " in the most recent session").otherwise(""), F.lit(" ?"))).otherwise("What now?")
    question = F.concat(asked, F.when(k % 2 == 0, F.concat(F.lit(" Session "), F.col("p_size").cast("string"), F.lit(" of 9"))).otherwise(" session 3"))
    return t.read(spark, sf_dir, "part").select(k.alias("id"), ids.question_object(question).alias("object"), ids.session_number(question).alias("session"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 700 = 428 OR event_id % 700 BETWEEN 500 AND 599 WHEN event_id % 4 = 1 THEN event_id % 3 = 0 ELSE false END AS retry FROM (SELECT event_id FROM events)""")
def retryable_errors(spark, sf_dir):
    v = F.col("event_id")
    status = F.when(v % 4 == 0, F.when(v % 700 == 428, 429).otherwise((v % 700).cast("int")))
    name = F.when((v % 4 == 1) & (v % 3 == 0), "APIConnectionError").otherwise("ValueError")
    return t.read(spark, sf_dir, "events").select("event_id", ids.retryable(status, name).alias("retry"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, 'my_model_' || user_id || '__memory__' || strftime(ts, '%Y%m%d') AS run FROM events")
def stamps(spark, sf_dir):
    name = F.concat(F.lit("my model/"), F.col("user_id").cast("string"))
    return t.read(spark, sf_dir, "events").select("event_id", ids.utc_stamp(F.col("ts")).alias("stamp"), ids.run_id(name, F.lit("memory"), F.date_format("ts", "yyyyMMdd")).alias("run"))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity * 64 AS INTEGER) AS w, CAST(l_suppkey * 8 + 16 AS INTEGER) AS h FROM lineitem)
    SELECT id, CAST(floor(w * least(1.0::DOUBLE, 640 / greatest(w, h)) / 2) * 2 AS INTEGER) AS width, CAST(floor(h * least(1.0::DOUBLE, 640 / greatest(w, h)) / 2) * 2 AS INTEGER) AS height, greatest(1, CAST(ceil(w / 1000 * 0.5::DOUBLE) AS INTEGER)) AS frames FROM s""")
def frame_sizes(spark, sf_dir):
    w, h = (F.col("l_quantity") * 64).cast("int"), (F.col("l_suppkey") * 8 + 16).cast("int")
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ids.scaled(w, h, 640, even=True).alias("s"), planning.window_frames(F.lit(0.0), w / 1000, 0.5).alias("frames"))
    return rows.select("id", "s.width", "s.height", "frames")


@query("""SELECT c_custkey AS id, sha256('{"key": ' || c_custkey || ', "name": "' || c_name || '", "tags": ["é", null]}') AS digest FROM customer""")
def canonical_digests(spark, sf_dir):
    said = F.concat(F.lit('{"tags":["\\u00e9",null],"name":"'), "c_name", F.lit('","key":'), F.col("c_custkey").cast("string"), F.lit("}"))
    return t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ids.canonical_digest(said).alias("digest"))


@query("SELECT conv_id, turn, regexp_replace(split_part(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ', 1), '\\.+$', '') AS token FROM conversations WHERE text IS NOT NULL")
def first_tokens(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", text.first_token(F.col("text")).alias("token"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    return live.windowed_counts(t.read(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window.start").alias("start"), "event_type", "n")
