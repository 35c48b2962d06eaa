"""Runs: what is left to do, health, replies, timeouts, and conformance of event logs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text


class Adapter(Protocol):
    """A system under test: it sees an environment's sessions and then answers its questions."""

    def on_env_begin(self, env_id: str) -> None: ...
    def ingest(self, session: dict) -> None: ...
    def on_ingest_end(self) -> None: ...
    def answer(self, query: dict) -> str: ...
    def on_env_end(self) -> None: ...


def run_adapter(make, sessions: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, status, raw): each environment's sessions in order, then its queries, through a fresh adapter.

    ``make`` builds an adapter in the worker.  A failing answer is an error of its item, a failing
    ingest of all items of the environment.
    """

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        try:
            adapter = make()
            adapter.on_env_begin(key[0])
            for s in left.sort_values("order").to_dict("records"):
                adapter.ingest(s)
            adapter.on_ingest_end()
        except Exception as e:  # noqa: BLE001  a system's failure is data
            return pd.DataFrame([(q, "error", str(e)) for q in right["item_id"]], columns=["item_id", "status", "raw"])
        for q in right.to_dict("records"):
            try:
                out.append((q["item_id"], "ok", adapter.answer(q)))
            except Exception as e:  # noqa: BLE001
                out.append((q["item_id"], "error", str(e)))
        adapter.on_env_end()
        return pd.DataFrame(out, columns=["item_id", "status", "raw"])

    return sessions.groupBy("env_id").cogroup(queries.groupBy("env_id")).applyInPandas(one, "item_id string, status string, raw string")


def unattempted(items: DataFrame, done: DataFrame, recorded: DataFrame) -> DataFrame:
    """Items with neither a finished nor a recorded row."""
    return items.join(done.select("item_id").union(recorded.select("item_id")), "item_id", "left_anti")


def parse_reply(answer_format: Column, reply: Column) -> Column:
    """A raw reply under the field its format expects: (answer, answer_text)."""
    clean = text.strip(F.coalesce(reply, F.lit("")))
    open_ = answer_format == "open"
    return F.struct(F.when(~open_, clean).alias("answer"), F.when(open_, clean).alias("answer_text"))


def timed_out(phase: Column, seconds: Column, startup: float = 600.0, ingest: float = 3600.0, query: float = 300.0) -> Column:
    limit = F.when(phase == "ready", startup).when(phase == "ingest", ingest).otherwise(query)
    return F.coalesce(seconds > limit, F.lit(False))


def run_health(runs: DataFrame) -> DataFrame:
    """(run_id, failed): exit code, item set, statuses, frames, latch, memory evidence and mode of each run's rows."""
    memory = F.col("context_mode") == "memory"
    bad = (
        (F.col("exit_code") != 0) | (F.col("status") != "ok") | (F.coalesce("total_frames", F.lit(0)) == 0) & (F.col("context_mode") != "blind") | (F.coalesce("sessions_without_frames", F.lit(0)) > 0)
        | F.coalesce("revocation_contested", F.lit(False)) | (memory & (F.coalesce("n_records", F.lit(0)) == 0) & (F.coalesce("memory_bytes", F.lit(0)) == 0)) | (F.col("context_mode") != F.col("expected_mode"))
    )
    return runs.groupBy("run_id").agg((F.bool_or(bad) | (F.countDistinct("item_id") != F.max("n_expected"))).alias("failed"))


def select_queries(queries: DataFrame, category: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    rows = queries.where(F.col("category") == category) if category else queries
    rows = rows.orderBy("category", "query_id").offset(offset)
    return rows.limit(limit) if limit is not None else rows


def reachable(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates (candidate, session) whose sessions all have a size."""
    sized = sizes.where("size is not null").select("session", F.lit(True).alias("sized"))
    bad = candidates.join(sized, "session", "left").where("sized is null").select("candidate").distinct()
    return candidates.join(bad, "candidate", "left_anti")


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("started_at")


def rows_of_run(rows: DataFrame, run_id: str, judge_model: str | None = None, prompt_version: str | None = None) -> DataFrame:
    """Predictions or judgements of a run by item, of one judge and prompt if named."""
    rows = rows.where(F.col("run_id") == run_id)
    rows = rows.where(F.col("judge.model") == judge_model) if judge_model else rows
    rows = rows.where(F.col("judge.prompt_version") == prompt_version) if prompt_version else rows
    return rows.orderBy("item_id")


def experiment_matrix(models: DataFrame, tag: str, tracks: list[str] | None = None) -> DataFrame:
    """(run_id, model, mode, gpu, batch): one run for each model (id, gpu) and track; the tracks of a model are one batch, in their order.

    Raises ValueError for ids that are no names or stand twice, a graphics card that two models share, and odd tracks.
    """
    tracks = ["blind", "memory", "oracle"] if tracks is None else tracks
    if not tracks or len(set(tracks)) != len(tracks) or set(tracks) - {"blind", "memory", "oracle"}:
        raise ValueError("tracks must be some of blind, memory and oracle, each once")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", tag):
        raise ValueError("a tag holds letters, digits, _ or - only")
    bad = models.where(~ids.valid_name(F.col("id"))).select("id").first() or models.groupBy("id").count().where("count > 1").first()
    if bad:
        raise ValueError(f"model id {bad['id']!r} is no name or stands twice")
    shared = models.where("gpu is not null").groupBy("gpu").count().where("count > 1").first() or models.where(r"gpu is not null and not gpu rlike '^[0-9]+\\z'").first()
    if shared:
        raise ValueError(f"graphics card {shared['gpu']!r} is shared or no index")
    track = F.posexplode(F.array(*map(F.lit, tracks))).alias("at", "mode")
    rows = models.select("id", "gpu", track)
    return rows.select(F.concat_ws("-", F.lit(tag), "id", "mode").alias("run_id"), F.col("id").alias("model"), "mode", "gpu", F.col("at").alias("batch"))


#: Checks of a reply by answer format, with whether a system must pass them.
REPLY_CHECKS = [("mcq5_is_letter", False), ("mcq_is_letter", True), ("open_has_text", True), ("numeric_has_value", True)]


def reply_conformance(replies: DataFrame) -> DataFrame:
    """(system, check, passed, required) from replies (system, answer_format, options, answer, answer_text).

    A choice must be a letter of its options, an open reply some text, a numeric one not blank; a format without replies passes nothing.
    """
    said = text.strip(F.coalesce("answer", F.lit("")))
    either = text.strip(F.coalesce("answer", "answer_text", F.lit("")))
    letter = F.coalesce(F.array_contains(F.map_keys("options"), F.upper(said)), F.lit(False))
    good = {"mcq5_is_letter": letter, "mcq_is_letter": letter, "open_has_text": text.strip(F.coalesce(F.nullif("answer_text", F.lit("")), "answer", F.lit(""))) != "", "numeric_has_value": either != ""}
    asked = lambda name: F.col("answer_format") == name.split("_")[0]
    facts = replies.groupBy("system").agg(*(F.coalesce(F.bool_and(F.when(asked(n), good[n])), F.lit(False)).alias(n) for n, _ in REPLY_CHECKS))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("passed"), F.lit(r).alias("required")) for n, r in REPLY_CHECKS)))
    return facts.select("system", rows.alias("r")).select("system", "r.*")


#: The ways a system may see an environment.
CONTEXT_MODES = ["memory", "oracle", "blind"]
#: Checks of an exchange in their order, with whether a system must pass them.
EXCHANGE_CHECKS = [
    ("handshake", True), ("declares_context_mode", True), ("specific_system_id", False), ("ingest_acknowledged", True), ("ingest_end_acknowledged", True), ("releases_media", True),
    ("answers_all", True), ("echoes_ids", True), ("accepts_env_end", True), ("survives_unknown", False),
]
EXCHANGE = "system string, seq long, type string, system_id string, context_mode string, session_id string, item_id string"


def exchange_conformance(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(system, check, passed, required) of recorded exchanges, rows as in ``EXCHANGE``, of many systems.

    ``held`` has (system, path): staged media a system still held after ingest ended, which only matters in memory mode.
    Without a handshake nothing else is told, and after an ingest that was not acknowledged nothing of the environment.
    An acknowledgement must come after what it is for, and a reply after its query.
    """
    log = log.select(*(c.split()[0] for c in EXCHANGE.split(", ")))
    first = log.groupBy("system").agg(F.min_by(F.struct("type", "system_id", "context_mode"), "seq").alias("r"))
    ready = F.col("r.type") == "ready"
    named = text.strip(F.coalesce("r.system_id", F.lit("")))
    told = first.select("system", ready.alias("handshake"), F.col("r.context_mode").isin(CONTEXT_MODES).alias("declares_context_mode"), ((named != "") & (F.lower(named) != "system")).alias("specific_system_id"), (F.col("r.context_mode") == "memory").alias("memory"))

    def answered(request: str, reply: str, on: str) -> DataFrame:
        """(system, requests, open): requests and those without a reply of their own after them, and replies to nothing."""
        at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("seq")))
        per = log.where(F.col("type").isin(request, reply)).groupBy("system", on).agg(at(request).alias("asked"), F.max(F.when(F.col("type") == reply, F.col("seq"))).alias("replied"))
        lacking = F.col("asked").isNotNull() & ~F.coalesce(F.col("replied") > F.col("asked"), F.lit(False))
        return per.groupBy("system").agg(F.count_if(lacking).alias(f"{request}_open"), F.count_if(F.col("asked").isNull()).alias(f"{request}_foreign"), F.count("asked").alias(f"{request}s"))

    def acknowledged(kind: str) -> Column:
        return F.max(F.when(F.col("type") == f"{kind}_ack", F.col("seq"))) > F.max(F.when(F.col("type") == kind, F.col("seq")))

    ends = log.groupBy("system").agg(
        acknowledged("ingest_end").alias("ingest_end_acknowledged"), acknowledged("env_end").alias("accepts_env_end"),
        (F.max("seq") > F.max(F.when(F.col("type") == "unknown", F.col("seq")))).alias("survives_unknown"),
    )
    facts = told.join(answered("ingest", "ingest_ack", "session_id"), "system", "left").join(answered("query", "answer", "item_id"), "system", "left").join(ends, "system")
    if held is not None:
        facts = facts.join(held.groupBy("system").agg(F.count("*").alias("held")), "system", "left")
    else:
        facts = facts.withColumn("held", F.lit(0))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    facts = facts.withColumns({
        "ingest_acknowledged": none("ingest_open"), "releases_media": ~F.coalesce("memory", F.lit(False)) | none("held"), "answers_all": none("query_open"), "echoes_ids": none("query_foreign"),
    })
    greeting, environment = ["declares_context_mode", "specific_system_id", "survives_unknown"], ["ingest_end_acknowledged", "releases_media", "answers_all", "echoes_ids", "accepts_env_end"]
    due = {"handshake": F.lit(True), **dict.fromkeys(greeting, F.col("handshake")), "ingest_acknowledged": F.col("handshake"), **dict.fromkeys(environment, F.col("handshake") & F.col("ingest_acknowledged"))}
    rows = F.array(*(F.when(due[n], F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed"), F.lit(r).alias("required"))) for n, r in EXCHANGE_CHECKS))
    return facts.select("system", F.explode(F.array_compact(rows)).alias("c")).select("system", "c.*")


def conformance(log: DataFrame, order: str = "seq") -> DataFrame:
    """(check, passed, required) of one system's event log (direction, type, item_id, answer_format, answer)."""
    w = Window.partitionBy("item_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumn("asked", F.coalesce(F.max((F.col("type") == "query").cast("int")).over(w), F.lit(0)) > 0)
    reply, first = F.col("type") == "answer", F.min_by("type", order)
    facts = seen.agg(
        (first == "ready").alias("handshake"), (F.count_if(F.col("type") == "ingest_ack") >= F.count_if(F.col("type") == "ingest")).alias("ingest_acknowledged"),
        (F.count_if(reply & ~F.col("asked")) == 0).alias("echoes_ids"), (F.count_if(reply) == F.count_if(F.col("type") == "query")).alias("answers_all"), (F.count_if(F.col("type") == "unknown_ok") > 0).alias("ignores_unknown"),
    )
    names = [("handshake", True), ("ingest_acknowledged", True), ("echoes_ids", True), ("answers_all", True), ("ignores_unknown", False)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed"), F.lit(r).alias("required")) for n, r in names)))
    return facts.select(rows.alias("r")).select("r.*")


class SessionState:
    """Checks one environment's events as they stream in, for ``transformWithStateInPandas``."""

    ORDER = ("env_begin", "ingest", "ingest_end", "query", "env_end")

    def init(self, handle) -> None:
        self._phase = handle.getValueState("phase", "phase int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        at = self._phase.get()[0] if self._phase.exists() else 0
        bad = []
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, kind in zip(events["seq"], events["type"], strict=True):
            phase = self.ORDER.index(kind) if kind in self.ORDER else at
            if phase < at:
                bad.append((key[0], int(seq), kind))
            at = max(at, phase)
        if at == len(self.ORDER) - 1:
            self._phase.clear()
        else:
            self._phase.update((at,))
        yield pd.DataFrame(bad, columns=["env_id", "seq", "type"])

    def close(self) -> None:
        pass
