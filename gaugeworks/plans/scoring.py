"""Queries on scores, comparisons, reports and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import compare, corpus, recordings, report, runs, scoring
from ..sources.readers import key_values, last_wins, tagged_union
from ..sources.sinks import content_hash
from . import tables as t
from .registry import query

COUNTS = ["n", "n_correct", "n_incorrect", "n_abstained", "n_error", "n_pending_judge"]
COUNTS_SQL = """count(*) FILTER (NOT needs_judge) AS n, count(*) FILTER (NOT needs_judge AND score >= 1) AS n_correct, count(*) FILTER (NOT needs_judge AND score < 1) AS n_incorrect,
    count(*) FILTER (NOT needs_judge AND score IS NOT NULL AND abstained) AS n_abstained, count(*) FILTER (NOT needs_judge AND score IS NULL) AS n_error, count(*) FILTER (needs_judge) AS n_pending_judge"""


def wilson_sql(k: str, n: str, sign: str) -> str:
    z, zz = repr(stats.Z95), repr(stats.Z95**2)
    p = f"(CAST({k} AS DOUBLE) / {n})"
    edge = "greatest(0.0::DOUBLE, {})" if sign == "-" else "least(1.0::DOUBLE, {})"
    return edge.format(
        f"({p} + {zz}::DOUBLE / (2 * {n})) / (1 + {zz}::DOUBLE / {n}) {sign} {z}::DOUBLE * sqrt(greatest({p} * (1 - {p}) / {n} + {zz}::DOUBLE / (4.0::DOUBLE * {n} * {n}), 0.0::DOUBLE)) / (1 + {zz}::DOUBLE / {n})"
    )


@query(f"WITH {t.SCORES_SQL} SELECT {COUNTS_SQL} FROM scores")
def score_breakdown_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown(t.scores(spark, sf_dir)).select(*COUNTS)


@query(f"WITH {t.SCORES_SQL} SELECT count(score) AS n, count(*) FILTER (NOT needs_judge AND score IS NULL) AS n_error, count(*) FILTER (score >= 1) AS n_correct FROM scores")
def score_breakdown_exclude_errors(spark, sf_dir):
    return scoring.breakdown(t.scores(spark, sf_dir), include_errors=False).select("n", "n_error", "n_correct")


@query(f"""WITH {t.SCORES_SQL}, c AS (SELECT axis, {COUNTS_SQL}, coalesce(sum(score), 0.0::DOUBLE) AS s FROM scores GROUP BY axis)
    SELECT axis, n, n_correct, n_incorrect, n_abstained, n_error, n_pending_judge, round(s / n, 6) AS mean, round({wilson_sql('s', 'n', '-')}, 6) AS ci95_low, round({wilson_sql('s', 'n', '+')}, 6) AS ci95_high FROM c""")  # fmt: skip
def score_breakdown_by_axis(spark, sf_dir):
    out = scoring.breakdown(t.scores(spark, sf_dir), "axis")
    return out.select("axis", *COUNTS, *(F.round(c, 6).alias(c) for c in ("mean", "ci95_low", "ci95_high")))


@query(f"WITH {t.SCORES_SQL} SELECT axis, count(*) FILTER (NOT needs_judge) AS n, count(*) FILTER (NOT needs_judge AND score >= 1) AS n_correct FROM scores GROUP BY GROUPING SETS ((axis), ())")
def score_grouping_sets(spark, sf_dir):
    return scoring.breakdown_sets(t.scores(spark, sf_dir)).select("axis", "n", "n_correct")


@query(f"""WITH {t.SCORES_SQL}, g AS (SELECT source AS grp, count(*) AS n, count(*) FILTER (score >= 1) AS k FROM scores GROUP BY source)
    SELECT grp, n, k, round({wilson_sql('k', 'n', '-')}, 6) AS lo, round({wilson_sql('k', 'n', '+')}, 6) AS hi FROM g""")  # fmt: skip
def wilson_by_group(spark, sf_dir):
    g = t.scores(spark, sf_dir).groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 1).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("grp", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("""SELECT doc_id AS item_id,
        CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            WHEN doc_id % 4 = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END WHEN doc_id % 4 = 2 AND doc_id % 7 = 0 THEN 0.25::DOUBLE END AS score,
        CASE WHEN doc_id % 10 = 3 THEN 'error' ELSE 'ok' END AS status,
        doc_id % 10 <> 3 AND doc_id % 4 = 0 AND doc_id % 3 = 1 AS abstained, doc_id % 10 <> 3 AND doc_id % 4 = 2 AND doc_id % 7 <> 0 AS needs_judge
    FROM documents""")
def score_prediction(spark, sf_dir):
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("mcq5", "numeric", "open", "mcq"))), (d % 4 + 1).cast("int"))
    options = F.create_map(*(F.lit(x) for pair in zip("ABCDE", ("red", "green", "blue", "black", text.UNANSWERABLE_TEXT), strict=True) for x in pair))
    choice = F.element_at(F.array(F.lit("**B**"), F.lit("I cannot tell from this."), F.lit("The answer is (C).")), (d % 3 + 1).cast("int"))
    number = F.when(d % 5 == 0, "no idea").otherwise(F.concat(F.lit("about "), F.col("n_chars").cast("string"), F.lit(" characters")))
    rows = t.read(spark, sf_dir, "documents").select(
        d.alias("item_id"), F.col("lang").alias("axis"), F.when(d % 10 == 3, "error").otherwise("ok").alias("status"), F.when(d % 4 == 3, "open").otherwise(kind).alias("answer_format"),
        F.when(d % 4 == 0, options).alias("options"), F.when(d % 4 == 0, choice).when(d % 4 == 1, number).alias("answer"), F.lit(None).cast("string").alias("answer_text"),
        F.lit("B").alias("gold_answer"), F.col("n_chars").cast("double").alias("gold_answer_numeric"), F.lit(None).cast("string").alias("abstention_option"), F.lit(False).alias("is_unanswerable"), F.lit(None).cast("boolean").alias("cross_session"),
    )
    judged = t.read(spark, sf_dir, "documents").where("doc_id % 4 = 2 AND doc_id % 7 = 0").select(d.alias("item_id"), F.lit(0.25).alias("judged"))
    out = scoring.score_predictions(rows, judged)
    three = F.col("item_id") % 4 == 3  # a fourth format stands in as open without a judge
    return out.select("item_id", "score", "status", "abstained", (F.col("needs_judge") & ~three).alias("needs_judge"))


REPLIES = [
    (1, "B", 0, "B"), (2, "**B**", 0, "B"), (3, "(c)", 0, "C"), (4, "The answer is D.", 0, "D"), (5, "A drawer", 1, "A"), (6, "the top shelf", 1, "C"), (7, "Not the drawer.", 1, None),
    (8, "It is in the sink or the drawer", 1, None), (9, "I cannot determine this.", 1, "E"), (10, "", 0, None), (11, "no letter here", 0, None), (12, "drawer", 1, "B"), (13, "C) top shelf", 1, "C"), (14, "Option: e", 1, "E"), (15, "F", 1, None),
]
OPTIONS = list(zip("ABCDE", ("sink", "drawer", "top shelf", "shelf", text.UNANSWERABLE_TEXT), strict=True))


def _replies(spark, sf_dir):
    golden = spark.createDataFrame(REPLIES, "id long, reply string, has int, gold string")
    turns = t.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.concat(F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("turn") % 5 + 1).cast("int")), F.lit(". "), F.col("text")).alias("reply"), F.lit(0).alias("has"), F.lit("B").alias("gold"))
    options = F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(b).alias("text")) for a, b in OPTIONS))
    rows = golden.unionByName(turns)
    return rows.withColumn("letter", text.choice_letter(F.col("reply"), F.when(F.col("has") == 1, options)))


_REPLY_VALUES = ", ".join(f"({i}, {'NULL' if g is None else repr(g)})" for i, _, _, g in REPLIES)
_LETTERS_SQL = f"SELECT CAST(id AS BIGINT) AS id, letter FROM (VALUES {_REPLY_VALUES}) v(id, letter) UNION ALL SELECT conv_id * 1000 + turn + 1000, substr('ABCDE', CAST(turn % 5 + 1 AS BIGINT), 1) FROM conversations"


@query(_LETTERS_SQL)
def mcq_extract(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", "letter")


@query("SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 6 THEN 'E' END AS letter FROM part")
def choice_cascade(spark, sf_dir):
    """Replies of eight kinds about each part: a letter, a phrasing, an option's text alone and inside, denied, two of them, an abstention, none."""
    k = F.col("p_partkey")
    options = F.array(*(F.struct(F.lit(a).alias("letter"), c.alias("text")) for a, c in zip("ABCDE", (F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("none of these parts"), F.lit(text.UNANSWERABLE_TEXT)), strict=True)))
    said = [F.lit("**C**"), F.lit("The answer is (d)."), F.upper("p_brand"), F.concat(F.lit("I think it is the "), F.lower("p_type")), F.concat(F.lit("It is not the "), "p_type"), F.concat("p_brand", F.lit(" or "), "p_type"), F.lit("I cannot determine this."), F.lit("something else")]
    reply = F.element_at(F.array(*said), (k % 8 + 1).cast("int"))
    return t.read(spark, sf_dir, "part").select(k.alias("id"), text.choice_letter(reply, options).alias("letter"))


@query(f"SELECT id, CASE WHEN letter = CASE WHEN id < 1000 THEN letter ELSE 'B' END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ({_LETTERS_SQL})")
def score_mcq(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", F.when(F.col("letter") == F.col("gold"), 1.0).otherwise(0.0).alias("score"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM nation")
def exact_match_ci(spark, sf_dir):
    k = F.col("n_nationkey")
    reply = F.when(k % 3 == 0, F.concat(F.lit(" \t"), F.lower("n_name"), F.lit("\n"))).when(k % 3 == 1, F.upper("n_name")).otherwise(F.concat("n_name", F.lit("x")))
    return t.read(spark, sf_dir, "nation").select(k.cast("long").alias("id"), text.exact_match(reply, F.col("n_name")).alias("score"))


NUMBERS = [
    (-1, "about 2.5 m", 2.5), (-2, "1,200 cm", 1200.0), (-3, "no number", None), (-4, "nan", None), (-5, "-inf", None), (-6, "1_000", 1000.0), (-7, "1e400", None), (-8, " 7. ", 7.0),
    (-9, "1.5d", 1.5), (-10, "0x1p3", 0.0), (-11, "", None), (-12, "x-3e2y", -300.0), (-13, ".5", 0.5),
]


@query(
    "SELECT CAST(id AS BIGINT) AS id, value FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)}::DOUBLE)" for i, _, v in NUMBERS) + ") v(id, value) "
    "UNION ALL SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) FROM orders"
)
def parse_number(spark, sf_dir):
    golden = spark.createDataFrame([(i, s) for i, s, _ in NUMBERS], "id long, s string")
    prices = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("about "), F.floor("o_totalprice").cast("string"), F.lit(" usd")).alias("s"))
    return golden.unionByName(prices).select("id", text.parse_number(F.col("s")).alias("value"))


_HITS = " + ".join(f"CAST(e <= {x!r}::DOUBLE AS INTEGER)" for x in stats.MRA_TOLERANCES)


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, abs(l_extendedprice / l_quantity - p_retailprice) / abs(p_retailprice) AS e FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, ({_HITS}) / 10.0::DOUBLE AS mra FROM p""")  # fmt: skip
def mra_score(spark, sf_dir):
    rows = t.read(spark, sf_dir, "lineitem").join(t.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", stats.relative_accuracy(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice")).alias("mra"))


@query("SELECT l_orderkey * 10 + l_linenumber AS key, (greatest(1.0::DOUBLE, least(5.0::DOUBLE, l_quantity / 5)) - 1) / 4 AS norm FROM lineitem")
def likert_normalise(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), stats.likert(F.col("l_quantity") / 5).alias("norm"))


@query("SELECT d.doc_id AS item_id, CAST(quality AS DOUBLE) AS score, quality IS NULL AS needs_judge FROM documents d LEFT JOIN labels USING (doc_id)")
def judge_left_join(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("axis"), F.lit("ok").alias("status"), F.lit("open").alias("answer_format"), F.lit(None).cast("map<string,string>").alias("options"), F.lit("x").alias("answer"),
        F.lit(None).cast("string").alias("answer_text"), F.lit(None).cast("string").alias("gold_answer"), F.lit(None).cast("double").alias("gold_answer_numeric"), F.lit(None).cast("string").alias("abstention_option"),
        F.lit(False).alias("is_unanswerable"), F.lit(None).cast("boolean").alias("cross_session"),
    )
    judged = t.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("double").alias("judged"))
    return scoring.score_predictions(rows, judged).select("item_id", "score", "needs_judge")


def _gain_sql(key: str) -> str:
    k, by, using = ("axis, ", "GROUP BY axis", "item_id, axis") if key else ("", "", "item_id")
    return f"""WITH {t.SCORES_SQL}, {t.SCORES_B_SQL}, p AS (SELECT {k}a.score AS a, b.score AS b, a.score - b.score AS d FROM scores a FULL JOIN scores_b b USING ({using})),
        g AS (SELECT {k}count(d) AS n, count(*) - count(d) AS x, avg(a) FILTER (d IS NOT NULL) AS ma, avg(b) FILTER (d IS NOT NULL) AS mb, avg(d) AS gain, coalesce(stddev_samp(d), 0.0::DOUBLE) AS sd, max(d) - min(d) AS spread FROM p {by})
        SELECT {k}n AS n_paired, x AS n_dropped, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(gain, 6) AS gain,
            round(gain - {stats.Z95!r}::DOUBLE * sd / sqrt(n), 6) AS ci95_low, round(gain + {stats.Z95!r}::DOUBLE * sd / sqrt(n), 6) AS ci95_high, n = 1 OR spread <= 1e-9 AS degenerate,
            NOT (n = 1 OR spread <= 1e-9) AND (gain - {stats.Z95!r}::DOUBLE * sd / sqrt(n) > 0 OR gain + {stats.Z95!r}::DOUBLE * sd / sqrt(n) < 0) AS significant FROM g WHERE n > 0"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "gain", "ci95_low", "ci95_high")})


@query(_gain_sql(""))
def paired_gain_overall(spark, sf_dir):
    return _rounded(compare.paired_gain(t.scores(spark, sf_dir), t.scores_b(spark, sf_dir)))


@query(_gain_sql("axis"))
def paired_gain_by_axis(spark, sf_dir):
    return _rounded(compare.paired_gain_by_axis(t.scores(spark, sf_dir), t.scores_b(spark, sf_dir)))


def _env_runs(spark, sf_dir):
    e = t.read(spark, sf_dir, "events")
    v = F.floor("value").cast("long")
    return e.select(F.col("user_id").alias("env_id"), (F.col("event_id") % 3 + 1).alias("n_sessions"), F.when(F.col("event_id") % 4 != 0, v).alias("n_records"), v.alias("total_frames"), (F.col("event_id") % 5).alias("sessions_without_frames"), (F.col("event_id") % 50 != 0).alias("fd_audit_available"), F.col("event_id").alias("ord"))


_INGEST_SQL = """last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    ingest AS (SELECT count(*) AS n_envs, CAST(sum(event_id % 3 + 1) AS BIGINT) AS n_sessions, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_records,
        CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_frames, CAST(sum(event_id % 5) AS BIGINT) AS sessions_without_frames, bool_and(event_id % 50 <> 0) AS fd_audit_available FROM last)"""


@query(f"WITH {_INGEST_SQL} SELECT * FROM ingest")
def ingest_evidence(spark, sf_dir):
    return report.ingest_evidence(_env_runs(spark, sf_dir))


@query(f"""WITH {t.SCORES_SQL}, {_INGEST_SQL}, c AS (SELECT {COUNTS_SQL} FROM scores)
    SELECT 'run-a' AS run_id, c.*, i.n_envs, i.total_frames, c.n_pending_judge > 0 AS note_pending, i.n_records = 0 AS note_no_records, i.sessions_without_frames > 0 AS note_blank FROM c, ingest i""")  # fmt: skip
def run_report(spark, sf_dir):
    header = spark.range(1).select(F.lit("run-a").alias("run_id"), F.lit("s").alias("system_id"), F.lit("memory").alias("context_mode"), F.lit(False).alias("revocation_contested"))
    out = report.assemble(header, t.scores(spark, sf_dir), _env_runs(spark, sf_dir))
    has = lambda part: F.exists("notes", lambda n: n.contains(part))
    return out.select("run_id", *COUNTS, "n_envs", "total_frames", has("await a judge").alias("note_pending"), has("no memory records").alias("note_no_records"), has("gave no frames").alias("note_blank"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return t.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT 'all' AS part, round(coalesce(sum(o_totalprice), 0.0::DOUBLE), 2) AS total FROM orders UNION ALL SELECT 'none', round(coalesce(sum(o_totalprice), 0.0::DOUBLE), 2) FROM orders WHERE o_orderkey < 0")
def total_cost(spark, sf_dir):
    orders = t.read(spark, sf_dir, "orders")
    total = F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total")
    return orders.agg(total).select(F.lit("all").alias("part"), "total").unionByName(orders.where("o_orderkey < 0").agg(total).select(F.lit("none").alias("part"), "total"))


@query("SELECT lang AS axis, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS n_cross FROM documents GROUP BY 1")
def axis_counts(spark, sf_dir):
    return corpus.axis_counts(t.read(spark, sf_dir, "documents").withColumnRenamed("lang", "axis"), F.col("doc_id") % 2 == 0)


@query("SELECT user_id AS env, bool_or(event_type = 'error' OR value < 1 OR value IS NULL) AS bad FROM events GROUP BY 1")
def run_health_gate(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.lit(0).alias("exit_code"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.greatest(F.floor("value"), F.lit(0)).alias("total_frames"),
        F.lit(0).alias("sessions_without_frames"), F.lit(False).alias("revocation_contested"), F.lit("frames").alias("context_mode"), F.lit("frames").alias("expected_mode"), F.lit(0).alias("n_records"), F.lit(0).alias("memory_bytes"),
    )
    rows = rows.join(rows.groupBy("run_id").agg(F.countDistinct("item_id").alias("n_expected")), "run_id")
    return runs.run_health(rows).select(F.col("run_id").alias("env"), F.col("failed").alias("bad"))


@query(f"WITH {t.SCORES_SQL} SELECT count(*) FILTER (status <> 'ok') AS n_error, count(*) FILTER (status = 'ok' AND needs_judge) AS n_unparsed, count(*) FILTER (status = 'ok' AND NOT needs_judge AND abstained) AS n_abstained, count(*) FILTER (status = 'ok' AND NOT needs_judge AND NOT abstained) AS n_committed, count(*) FILTER (status = 'ok' AND NOT needs_judge AND NOT abstained AND score >= 0.5) AS n_right FROM scores")
def shortcut_decomposition(spark, sf_dir):
    rows = t.scores(spark, sf_dir).withColumn("letter", F.when(~F.col("needs_judge"), F.when(F.col("score") >= 0.5, "B").otherwise("A"))).withColumn("gold", F.lit("B"))
    return report.shortcut_decomposition(rows)


TESTS = [(25, 66, 0.25), (0, 10, 0.5), (10, 10, 0.5), (5, 10, 0.5), (0, 0, 0.3), (520, 1100, 0.5), (3, 40, 0.1)]


@query(
    "WITH v AS (SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CAST(p AS DOUBLE) AS p FROM (VALUES " + ", ".join(map(str, TESTS)) + ") v(k, n, p) UNION SELECT count(*) FILTER (event_type = 'click'), least(count(*), 1100), 0.2 FROM events GROUP BY user_id), "
    "l AS (SELECT v.k, v.n, v.p, i, lgamma(v.n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(v.n - i + 1.0::DOUBLE) + i * ln(v.p) + (v.n - i) * ln(1 - v.p) AS lp FROM v, range(0, 1101) r(i) WHERE i <= v.n), "
    "s AS (SELECT a.k, a.n, a.p, sum(exp(a.lp)) FILTER (a.lp <= b.lp + 1e-9) AS s FROM l a JOIN l b ON a.k = b.k AND a.n = b.n AND a.p = b.p AND b.i = b.k GROUP BY a.k, a.n, a.p) "
    "SELECT k, n, p, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, s) END, 8) AS pvalue FROM s"
)
def binomial_test(spark, sf_dir):
    """Given cases, and the clicks among each user's events against a share of 0.2."""
    per = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("k"), F.least(F.count("*"), F.lit(1100)).alias("n"))
    rows = spark.createDataFrame(TESTS, "k long, n long, p double").union(per.select("k", "n", F.lit(0.2))).distinct()
    return rows.select("k", "n", "p", F.round(stats.binomial_two_sided(F.col("k"), F.col("n"), F.col("p")), 8).alias("pvalue"))


_TOKENS_SQL = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?|[\x{4e00}-\x{9fff}]')"


@query(f"""WITH w AS (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i+3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w)),
    c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds, max(n) AS most FROM c GROUP BY 1)
    SELECT w.doc_id, CAST(len(w) AS INTEGER) AS tokens_approx, coalesce(len(w) >= 20 AND 1 - kinds / CAST(total AS DOUBLE) >= 0.4 AND most >= 3, false) AS repetitive FROM w LEFT JOIN s USING (doc_id)""")
def ngram_repetition(spark, sf_dir):
    return report.output_diagnostics(t.read(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens_approx", "repetitive")


_REFUSES = " OR ".join("contains(s, '{}')".format(p.replace("'", "''")) for p in text.REFUSALS)


@query(f"SELECT conv_id, turn, {_REFUSES} AS refusal, regexp_full_match(s, '\\s*') AS empty FROM (SELECT conv_id, turn, replace(lower(text), '’', '''') AS s FROM conversations)")
def refusal_flags(spark, sf_dir):
    return report.output_diagnostics(t.read(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "refusal", "empty")


def _words_sql(c: str) -> str:
    return f"regexp_extract_all(translate(lower({c}), '{text.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '[a-z0-9]+')"


_LEXICAL_SQL = f"""{t.PAIRS_SQL}, w AS (SELECT conv_id, turn, {_words_sql('reply')} AS r, {_words_sql('gold')} AS g FROM pairs),
    cr AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS word FROM w) GROUP BY ALL),
    cg AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS word FROM w) GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(cr.n, cg.n)) AS same FROM cr JOIN cg USING (conv_id, turn, word) GROUP BY ALL),
    x AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, array_to_string(r, ' ') = array_to_string(g, ' ') AS exact, len(g) > 0 AND contains(array_to_string(r, ' '), array_to_string(g, ' ')) AS substring,
        CASE WHEN len(r) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN len(r) = 0 OR len(g) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * CAST(coalesce(same, 0) AS DOUBLE) / (len(r) + len(g)) END AS f1 FROM w LEFT JOIN s USING (conv_id, turn))"""


def _lexical(spark, sf_dir):
    return report.lexical_scores(t.pairs(spark, sf_dir), "reply", "gold").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"WITH {_LEXICAL_SQL} SELECT id, round(f1, 6) AS f1 FROM x")
def token_f1(spark, sf_dir):
    return _lexical(spark, sf_dir).select("id", F.round("f1", 6).alias("f1"))


@query(f"WITH {_LEXICAL_SQL} SELECT id, exact, substring FROM x")
def lexical_scores(spark, sf_dir):
    return _lexical(spark, sf_dir).select("id", "exact", "substring")


@query(f"""WITH {_LEXICAL_SQL} SELECT turn % 4 AS category, count(*) AS n, count(*) FILTER (id % 10 <> 3) AS ok, count(*) FILTER (id % 10 <> 3 AND exact) AS exact,
    count(*) FILTER (id % 10 <> 3 AND substring) AS substring, round(avg(f1) FILTER (id % 10 <> 3), 6) AS mean_f1 FROM x GROUP BY 1""")
def caption_eval_by_category(spark, sf_dir):
    rows = _lexical(spark, sf_dir).select((F.col("turn") % 4).alias("category"), F.when(F.col("id") % 10 != 3, "ok").otherwise("error").alias("status"), "exact", "substring", "f1")
    return report.caption_eval(rows, "category").withColumn("mean_f1", F.round("mean_f1", 6))


@query("""WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT (SELECT count(*) FROM events) AS n_items, (SELECT count(*) FROM last) AS n_envs, (SELECT count(*) FROM events WHERE event_type <> 'error') AS n_output,
        (SELECT count(*) FROM events WHERE event_type = 'click') AS refusal, (SELECT count(*) FROM events WHERE event_type = 'view') AS repeated,
        (SELECT round(quantile_cont(value, 0.5), 6) FROM events WHERE event_type <> 'error') AS p50_ms, (SELECT round(quantile_cont(value, 0.95), 6) FROM events WHERE event_type <> 'error') AS p95_ms,
        (SELECT CAST(sum(event_id % 3) AS DOUBLE) FROM last) AS ingest_seconds, (SELECT CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) FROM last) AS frames, (SELECT max(event_id % 1000) FROM last) AS max_memory_bytes,
        (SELECT bool_or(event_id % 7 = 0) FROM last) AS contested, (SELECT CAST(sum(event_id % 5) AS BIGINT) FROM last) AS sessions_without_frames, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS n_purchase""")
def run_summary(spark, sf_dir):
    """Events stand in for predictions: clicks reply with a refusal, views with one word over and over, the others with their type."""
    e, kind, v = t.read(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    reply = F.when(kind == "click", "I cannot see this.").when(kind == "view", F.repeat(F.lit("again "), F.lit(30))).otherwise(kind)
    run = F.struct((v % 3).cast("double").alias("ingest_seconds"), F.floor("value").cast("long").alias("total_frames"), (v % 1000).alias("memory_bytes"), (v % 7 == 0).alias("revocation_contested"), (v % 5).alias("sessions_without_frames"), F.lit("none").alias("enforcement"))
    rows = e.select(v.alias("item_id"), F.col("user_id").alias("env_id"), F.when(kind == "error", "error").otherwise("ok").alias("status"), kind.alias("answer"), reply.alias("reply"), F.col("value").alias("latency_ms"), run.alias("env_run"), v.alias("ord"))
    out = report.run_summary(rows, e.select(v.alias("item_id")))
    columns = ["n_items", "n_envs", "n_output", "refusal", "repeated", "ingest_seconds", "frames", "max_memory_bytes", "contested", "sessions_without_frames"]
    return out.select(*columns, F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), F.try_element_at("answers", F.lit("purchase")).alias("n_purchase"))


@query("SELECT 'a' || user_id AS probe, count(DISTINCT event_type || CAST(event_id % 2 AS VARCHAR)) AS n_arms, count(DISTINCT event_type || CAST(event_id % 2 AS VARCHAR)) = 10 AS complete FROM events GROUP BY 1")
def arm_matrix(spark, sf_dir):
    arms = [f"{k}{i}" for k in ("click", "error", "purchase", "signup", "view") for i in (0, 1)]
    probes = t.read(spark, sf_dir, "events").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("probe"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("arm"))
    return report.arm_matrix(probes, "probe", "arm", arms)


@query("""SELECT count(*) AS events, count(*) FILTER (event_type <> 'error') AS completed_generations, count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS notes_at_token_limit,
    round(coalesce(sum(value) FILTER (event_type <> 'error'), 0.0::DOUBLE), 1) AS encode_seconds, coalesce(max(event_id % 4096) FILTER (event_type <> 'error'), 0) AS max_prompt_tokens FROM events""")
def trace_summary(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    rows = t.read(spark, sf_dir, "events").select(
        F.when(kind == "error", "failed").otherwise("generate_done").alias("event"), F.when(kind == "view", "note").otherwise("answer").alias("phase"), (n % 2 == 0).alias("at_token_limit"),
        F.col("value").alias("encode_seconds"), *(F.lit(None).cast("double").alias(f"{x}_seconds") for x in ("transfer", "generate", "decode")), (n % 4096).alias("prompt_tokens"),
    )
    out = recordings.trace_summary(rows)
    return out.select("events", "completed_generations", "notes_at_token_limit", F.round("encode_seconds", 1).alias("encode_seconds"), "max_prompt_tokens")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    out = report.latency_percentiles(t.read(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT p_partkey AS id, 'Which part is it?' || chr(10) || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type || chr(10) || chr(10) || 'Answer with the single letter of the best option and nothing else.' AS prompt FROM part")
def render_prompt(spark, sf_dir):
    options = F.array(*(F.struct(F.lit(a).alias("letter"), F.col(c).alias("text")) for a, c in (("C", "p_type"), ("A", "p_name"), ("B", "p_brand"))))
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.render_prompt(F.lit("Which part is it?"), F.lit("mcq"), options, F.lit(None).cast("string")).alias("prompt"))


@query("SELECT conv_id, md5(string_agg('TURN ' || turn || ' ' || role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1")
def ordered_text_assembly(spark, sf_dir):
    line = F.struct("turn", F.concat(F.lit("TURN "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit(": "), "text").alias("line"))
    rows = t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text_md5"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}\-_.]', '_', 'g') AS slug FROM pages")
def slugify(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents", name="content_hash")
def content_hashes(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("sha256"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 2) AS INTEGER) % 4 AS BIGINT) AS choice FROM documents")
def hash_choice(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", text.hash_choice(F.col("text"), F.lit(4)).alias("choice"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages")
def html_escape(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped_md5"))


@query("SELECT conv_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def octet_lengths(spark, sf_dir):
    return t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))


VERBS = [("put-in", True), ("put-down", True), ("take-from", False), ("put", True), ("Place-On", True), ("put-out", False), ("move", True), ("wash", False), ("return-to", True)]


@query("SELECT verb, is_placement FROM (VALUES " + ", ".join(f"('{v}', {p})" for v, p in VERBS) + ") v(verb, is_placement) UNION ALL SELECT DISTINCT 'store-' || lower(split_part(p_type, ' ', 1)), false FROM part")
def compound_verb_filter(spark, sf_dir):
    golden = spark.createDataFrame([(v,) for v, _ in VERBS], "verb string")
    made = t.read(spark, sf_dir, "part").select(F.concat(F.lit("store-"), F.lower(F.substring_index("p_type", " ", 1))).alias("verb")).distinct()
    return golden.unionByName(made).select("verb", text.is_placement(F.col("verb")).alias("is_placement"))


NARRATIONS = [
    (1, "put knife in drawer", "put-in", "drawer", "drawer"), (2, "put plate into the top cupboard", "put-into", "cupboard", "top cupboard"), (3, "put plate cupboard", "put-in", "cupboard", "cupboard"),
    (4, "put down bowl", "put-down", None, None), (5, "put it in hand and then on the table", "put", "table", "table"), (6, "pour water in bowl", "pour-in", None, None), (7, "return milk to the fridge, close it", "return-to", "fridge", "fridge"),
]


@query("SELECT CAST(id AS BIGINT) AS id, head, surface FROM (VALUES " + ", ".join(f"({i}, {'NULL' if h is None else repr(h)}, {'NULL' if s is None else repr(s)})" for i, _, _, h, s in NARRATIONS) + ") v(id, head, surface) "
    "UNION ALL SELECT 1000 + p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'drawer' WHEN 1 THEN 'cupboard' WHEN 2 THEN 'table' END, CASE p_partkey % 4 WHEN 0 THEN 'drawer' WHEN 1 THEN 'top cupboard' WHEN 2 THEN 'table' END FROM part")
def parse_destination(spark, sf_dir):
    """Given narrations, and one a part."""
    k = F.col("p_partkey")
    said = F.concat(F.lit("put "), F.element_at(F.split("p_name", " "), 1), F.when(k % 4 == 0, " in drawer").when(k % 4 == 1, " into the top cupboard").when(k % 4 == 2, " in hand and then on the table").otherwise(" away"))
    told = t.read(spark, sf_dir, "part").select((k + 1000).alias("id"), said, F.when(k % 4 == 0, "put-in").when(k % 4 == 1, "put-into").when(k % 4 == 2, "put").otherwise("put-down"))
    rows = spark.createDataFrame([r[:3] for r in NARRATIONS], "id long, narration string, verb string").union(told).withColumn("d", text.destination(F.col("narration"), F.col("verb")))
    return rows.select("id", F.col("d.head").alias("head"), F.col("d.surface").alias("surface"))


@query("SELECT p_partkey AS id, unnest(['brand', 'size']) AS key, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS value FROM part")
def parse_kv_map(spark, sf_dir):
    packed = F.concat(F.lit("brand="), "p_brand", F.lit("|size="), F.col("p_size").cast("string"))
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(key_values(packed)).alias("key", "value"))


@query("SELECT source_tag AS tag, count(*) AS n FROM (SELECT 'region' AS source_tag FROM region UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'supplier' FROM supplier) GROUP BY 1", name="tagged_union")
def tagged_union_counts(spark, sf_dir):
    parts = {n: t.read(spark, sf_dir, n).select(F.col(c).cast("long").alias("id")) for n, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"))}
    return tagged_union(parts, "tag").groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0)
    SELECT 'both' AS op, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)
    UNION ALL SELECT 'first', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)""")
def set_ops_ids(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderkey") % k == 0).select(F.col("o_custkey").alias("id")) for k in (2, 3))
    n = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("both", a.intersect(b)).unionByName(n("either", a.union(b).distinct())).unionByName(n("first", a.distinct().subtract(b)))


@query("SELECT user_id, bool_and(event_type IN ('click', 'view', 'purchase', 'signup')) AS ok FROM events GROUP BY 1")
def subset_filter(spark, sf_dir):
    kinds = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    allowed = F.array(*map(F.lit, ("click", "view", "purchase", "signup")))
    return kinds.select("user_id", ((F.size(F.array_except("kinds", allowed)) == 0) & (F.size("kinds") > 0)).alias("ok"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_last_wins(spark, sf_dir):
    return last_wins(t.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT conv_id, count(*) = max(turn) + 1 AND min(turn) = 0 AND count(DISTINCT turn) = count(*) AS ok FROM conversations GROUP BY 1")
def order_permutation_check(spark, sf_dir):
    return corpus.permutation_check(t.read(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_text(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")
