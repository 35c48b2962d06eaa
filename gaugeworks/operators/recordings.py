"""Questions over recordings: eligibility, captions, traces, conformance and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from . import planning, ranges

UNANSWERABLE_CHOICE = "This question can not be answered."
MODALITIES = ["Video", "OCR"]


def known_starts(qa: DataFrame) -> DataFrame:
    """(video_id, start) of recordings whose start all rows agree on."""
    own = qa.select(F.col("metadata.primary_video_id").alias("video_id"), F.col("metadata.primary_video_start_time").alias("start"))
    seen = qa.select(F.explode("answer_evidence.evidence_list").alias("e")).select("e.video_id", F.col("e.start_time").alias("start"))
    both = own.unionByName(seen).where("video_id is not null and start is not null")
    return planning.unambiguous(both, "video_id", "start").select(F.col("key").alias("video_id"), F.col("value").alias("start"))


def eligibility(qa: DataFrame, max_current_seconds: float = 1200.0, history: bool = False) -> DataFrame:
    """Adds boundary, recordings and reason: the first rule that excludes a row, null for eligible ones.

    The starts of all recordings a row names are joined by row, so nothing is broadcast.
    """
    evidence, spans = F.col("answer_evidence.evidence_list"), F.col("question_evidence.time_spans")
    primary, choice = F.col("metadata.primary_video_id"), F.col("correct_option_index")
    named = F.array_distinct(F.array_compact(F.concat(F.array(primary), F.transform(evidence, lambda e: e["video_id"]), F.coalesce("video_ids", F.array().cast("array<string>")))))
    starts = known_starts(qa)
    found = qa.select("question_id", F.explode(named).alias("video_id")).join(starts, "video_id").groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("video_id", "start"))).alias("__known"))
    rows = qa.join(found, "question_id", "left").withColumn("__known", F.coalesce("__known", F.create_map().cast("map<string,double>")))
    start = lambda v: F.try_element_at(F.col("__known"), v)
    cutoff = F.array_min(F.transform(spans, lambda s: s["start_time"]))
    boundary = start(primary) + cutoff
    listed = F.array_distinct(F.concat(F.coalesce("video_ids", F.array().cast("array<string>")), F.array(primary)))
    before = F.array_sort(F.transform(F.filter(listed, lambda v: start(v) < boundary), lambda v: F.struct(start(v).alias("start"), v.alias("video_id"))))
    recordings = F.transform(before, lambda r: r["video_id"]) if history else F.array(primary)
    asked = F.col("question_evidence.modalities")
    foreign = lambda m: m.isNull() | (F.size(m) == 0) | (F.size(F.array_except(m, F.array(*map(F.lit, MODALITIES)))) > 0)
    count = F.size(F.filter("choices", lambda c: c == UNANSWERABLE_CHOICE))
    invalid = (
        F.coalesce((F.size("choices") != 4) | F.exists("choices", lambda c: c.isNull() | c.rlike(r"^\s*\z")), F.lit(True))
        | choice.isNull() | (choice < 0) | (choice > 3) | ~F.get("choices", choice).eqNullSafe(F.col("correct_answer")) | ~F.get("choice_types", choice).eqNullSafe(F.lit("correct"))
        | (count != 1) | ~ids.valid_video_id(primary) | F.exists(evidence, lambda e: ~ids.valid_video_id(e["video_id"]) | ~ids.valid_window(e["time_span"]["start_time"], e["time_span"]["end_time"]))
        | F.exists(spans, lambda s: ~ids.valid_window(s["start_time"], s["end_time"]))
    )
    flaw = F.get(
        F.filter(
            F.transform(evidence, lambda e: F.when(start(e["video_id"]).isNull() | (start(e["video_id"]) != e["start_time"]), "unknown_or_conflicting_recording_time")
                .when(start(e["video_id"]) + e["time_span"]["end_time"] > boundary, "answer_evidence_after_query_boundary")
                .when(F.lit(not history) & (e["video_id"] != primary), "requires_cross_session_context")),
            lambda r: r.isNotNull()), 0)
    rules = [
        ("invalid_source_row", invalid),
        ("unanswerable_not_in_visual_pilot", ~F.coalesce(F.col("is_answerable"), F.lit(False))),
        ("missing_evidence", F.coalesce(F.size(evidence), F.lit(0)).isin(0, -1) | F.coalesce(F.size(spans), F.lit(0)).isin(0, -1)),
        ("requires_nonvisual_or_unknown_modality", foreign(asked) | F.exists(evidence, lambda e: foreign(e["modalities"]))),
        ("ambiguous_query_recording", F.exists(spans, lambda s: ~F.coalesce(s["video_id"], F.col("question_evidence.video_id")).eqNullSafe(primary))),
        ("query_prefix_outside_budget", ~((cutoff > 0) & (cutoff <= max_current_seconds))),
        ("unknown_or_conflicting_recording_time", start(primary).isNull()),
    ]
    reason = F.coalesce(planning.first_reason(rules), flaw)
    if history:
        reason = F.coalesce(reason, F.when(F.exists(listed, lambda v: start(v).isNull()), "history_has_unknown_recording_times"), F.when(F.exists(evidence, lambda e: ~F.array_contains(recordings, e["video_id"])), "evidence_not_in_official_history"))
    return rows.withColumns({"boundary": boundary, "recordings": recordings, "reason": reason}).drop("__known")


def caption_texts(captions: DataFrame, mode: str = "summary") -> DataFrame:
    """(video_idx, said, n): the text of each video, made once, and its number of segments.

    Modes: summary, summary_speech, important (one last event a scene).
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda tag, x: F.when(text(x["text"]) != "", F.concat(F.lit(f"{tag} "), part(x["t"]), F.lit(": "), text(x["text"])))
    none = F.array().cast("array<string>")

    def scene(s: Column) -> Column:
        head = F.concat(F.lit("SCENE "), part(s["scene_id"]), F.lit(" time_of_day="), part(s["time_of_day"]), F.lit(" place="), part(s["place"]))
        lines = F.array(head, F.when(text(s["activity_summary"]) != "", F.concat(F.lit("CAPTION: "), text(s["activity_summary"]))))
        if mode == "summary_speech":
            lines = F.concat(lines, F.coalesce(F.transform(s["speech"], lambda x: line("SPEECH", x)), none))
        if mode == "important":
            lines = F.concat(lines, F.when(F.size(s["events"]) > 0, F.array(line("EVENT", F.element_at(s["events"], -1)))).otherwise(none))
        return F.array_join(F.array_compact(lines), "\n")

    head = F.concat(F.lit("VIDEO "), F.col("video_idx").cast("string"), F.lit(" id="), F.col("video_id"), F.lit(" weekday="), part(F.col("time_of_week")))
    return captions.select("video_idx", F.array_join(F.concat(F.array(head), F.transform("segments", scene)), "\n").alias("said"), F.size("segments").alias("n"))


def caption_prefixes(texts: DataFrame, cutoffs: DataFrame, range_rows: int | None = None) -> DataFrame:
    """(cutoff, n_videos, n_segments, n_chars): how much of ``caption_texts``, joined line by line in order, each distinct cutoff sees.

    A cutoff sees a prefix, so its length tells it all: the result has a row a cutoff and no text.  Running totals
    over ranges of video numbers take the place of a join of cutoffs with the videos up to them.  -1 sees everything.
    """
    zero = F.lit(0).cast("long")
    videos = texts.groupBy(F.col("video_idx").cast("long").alias("v")).agg(F.count("*").alias("c"), F.sum("n").cast("long").alias("s"), F.sum(F.length("said") + 1).cast("long").alias("l"))
    asked = cutoffs.select(F.col("cutoff").cast("long").alias("v")).distinct().select("v", zero.alias("c"), zero.alias("s"), zero.alias("l"))
    marks = videos.unionByName(asked).groupBy("v").agg(*(F.sum(x).alias(x) for x in "csl"))
    seen = ranges.running_totals(marks, [], ["v"], {"n_videos": "c", "n_segments": "s", "n_chars": "l"}, range_rows)
    total = videos.agg(*(F.coalesce(F.sum(x), zero).alias(f"all_{x}") for x in "csl"))
    pick = lambda x, name: F.when(F.col("cutoff") == -1, F.col(f"all_{x}")).otherwise(F.col(name)).alias(name)
    rows = cutoffs.select("cutoff").distinct().join(seen, F.col("cutoff") == F.col("v")).crossJoin(F.broadcast(total))  # one row
    rows = rows.select("cutoff", pick("c", "n_videos"), pick("s", "n_segments"), pick("l", "n_chars"))
    return rows.withColumn("n_chars", F.greatest(F.col("n_chars") - 1, F.lit(0)))  # no line end after the last


def caption_context(captions: DataFrame, cutoffs: DataFrame, mode: str = "summary") -> DataFrame:
    """(cutoff, context, n_videos, n_segments): what a reader of each distinct cutoff is given.

    For consumers that need the text itself: the whole text is put together once, in one row, and each cutoff cuts its prefix.
    """
    texts = caption_texts(captions, mode)
    whole = texts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("video_idx", "said"))), lambda x: x["said"]), "\n").alias("whole"))
    rows = caption_prefixes(texts, cutoffs).crossJoin(whole)  # one row
    return rows.select("cutoff", F.left("whole", F.col("n_chars").cast("int")).alias("context"), "n_videos", "n_segments")


def trace_summary(trace: DataFrame) -> DataFrame:
    """One row: finished generations, notes at their token limit, seconds by kind, largest prompt."""
    done = F.col("event") == "generate_done"
    total = lambda c, cond: F.round(F.coalesce(F.sum(F.when(cond, F.coalesce(c, F.lit(0.0)))), F.lit(0.0)), 3).alias(c)
    kinds = ("encode_seconds", "transfer_seconds", "generate_seconds", "decode_seconds")
    return trace.agg(
        F.count("*").alias("events"), F.count_if(done).alias("completed_generations"), F.count_if(done & (F.col("phase") == "note") & F.coalesce("at_token_limit", F.lit(False))).alias("notes_at_token_limit"),
        *(total(c, done) for c in kinds), F.coalesce(F.max(F.when(done, F.col("prompt_tokens"))), F.lit(0)).alias("max_prompt_tokens"),
    )


def conformance_summary(results: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(failed & F.col("required")).alias("failed_required"), F.count_if(failed & ~F.col("required")).alias("failed_advisory"))


def download_budget(files: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, n_files, missing_bytes): what is still to fetch."""
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.when(~F.col("present"), F.col("expected_bytes"))), F.lit(0)).alias("missing_bytes"))


def official_files(plan: DataFrame, official: DataFrame) -> DataFrame:
    """Planned files (path) with size and sha256 of the official list (path, size, sha256).

    Raises ValueError where a planned file is not official, has no size, or no checksum of 64 digits.
    """
    rows = plan.join(official.select("path", "size", "sha256", F.lit(True).alias("__there")), "path", "left")
    digits = F.coalesce(F.col("sha256").rlike(r"^[a-f0-9]{64}\z"), F.lit(False))
    flaw = rows.where(F.col("__there").isNull() | ~F.coalesce(F.col("size") > 0, F.lit(False)) | ~digits).select("path").first()
    if flaw:
        raise ValueError(f"{flaw['path']}: absent from the official list, or without size and checksum there")
    return rows.drop("__there")


def download_verdict(budgets: DataFrame, max_bytes: int, free_bytes: int, reserve_bytes: int) -> DataFrame:
    """Adds ``verdict`` to (missing_bytes): over the download budget, short of the space to keep free, or ok."""
    missing = F.col("missing_bytes")
    return budgets.withColumn("verdict", F.when(missing > max_bytes, "over_budget").when(missing + reserve_bytes > free_bytes, "no_space").otherwise("ok"))


def instance_histograms(instances: DataFrame) -> DataFrame:
    """(histogram, key, n): instances by type, objects by motion, distinct dynamic ids, and sequences by their number of dynamic objects."""
    kind, motion = F.coalesce("instance_type", F.lit("missing")), F.coalesce("motion_type", F.lit("missing"))
    row = lambda name, key: (F.lit(name).alias("histogram"), key.cast("string").alias("key"))
    objects = instances.where("instance_type = 'object'")
    moving = objects.where("motion_type = 'dynamic'")
    out = instances.groupBy(*row("instance_type", kind)).agg(F.count("*").alias("n"))
    out = out.unionByName(objects.groupBy(*row("motion_type", motion)).agg(F.count("*").alias("n")))
    out = out.unionByName(moving.agg(F.countDistinct("instance_id").alias("n")).select(*row("unique_dynamic", F.lit("")), "n"))
    return out.unionByName(instance_inventory(instances.withColumn("motion_type", F.when(F.col("instance_type") == "object", F.col("motion_type")))).select(*row("dynamic_per_sequence", F.col("n_dynamic")), F.col("n_sequences").alias("n")))


def header_variants(headers: DataFrame, required: list[str]) -> DataFrame:
    """(header, n, complete): how often each header (array) occurs, and whether it has all required names, none twice."""
    whole = (F.size(F.array_distinct("header")) == F.size("header")) & (F.size(F.array_except(F.array(*map(F.lit, required)), F.col("header"))) == 0)
    return headers.groupBy("header").agg(F.count("*").alias("n")).withColumn("complete", whole)


def instance_inventory(instances: DataFrame) -> DataFrame:
    """(n_dynamic, n_sequences): how many sequences have how many distinct dynamic instances."""
    per = instances.groupBy("sequence").agg(F.countDistinct(F.when(F.col("motion_type") == "dynamic", F.col("instance_id"))).alias("n_dynamic"))
    return per.groupBy("n_dynamic").agg(F.count("*").alias("n_sequences"))


def first_clips(clips: DataFrame, digest: str, order: str) -> DataFrame:
    """One clip for each digest, the first by ``order``."""
    return clips.groupBy(digest).agg(F.min_by(F.struct("*"), order).alias("c")).select("c.*")
