"""Session reports: markdown, summaries, runtime metadata and the session view.

A report holds themes, quotes and alerts of one session, never its reviews (only a session below
the low-data limit lists them), so its lines fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale import rules, schemas
from chorale.functions.text import trim_words
from chorale.functions.values import fixed
from chorale.operators import gates, lookups
from chorale.operators.ranking import by_priority, top_k

S = "session_id"


def yes_no(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def executive_summary(sessions: DataFrame, clusters: DataFrame, alerts: DataFrame) -> DataFrame:
    """(session_id, executive_summary): top three themes, spike count, degraded note.

    ``sessions``: session_id, degraded_mode.
    """
    best = top_k(clusters, [S], by_priority(), 3)
    theme = F.concat("label", F.lit(" ("), F.col("size").cast("string"), F.lit(" reviews, priority "), fixed(F.col("priority_score")), F.lit(")"))
    themes = best.groupBy(S).agg(F.array_sort(F.collect_list(F.struct("rank", theme.alias("t")))).alias("_t"))
    spikes = gates.material_alerts(alerts).groupBy(S).agg(F.count("*").alias("_spikes"))
    text = F.concat(
        F.lit("The batch is dominated by "), F.array_join(F.transform("_t", lambda t: t["t"]), "; "),
        F.lit(". Detected anomaly spikes: "), F.coalesce("_spikes", F.lit(0)).cast("string"), F.lit("."),
        F.when(F.col("degraded_mode"), " The run completed in degraded mode.").otherwise(""),
    )
    joined = sessions.join(themes, S, "left").join(spikes, S, "left")
    none = "No themes were extracted from the uploaded batch."
    return joined.select(S, trim_words(F.coalesce(text, F.lit(none)), 200).alias("executive_summary"))


def _line(section: int, text: Column, *order: Column) -> Column:
    """A sortable report line."""
    padded = [c.cast("double") for c in order] + [F.lit(0.0)] * (4 - len(order))
    return F.struct(F.lit(section).alias("section"), *[c.alias(f"o{i}") for i, c in enumerate(padded)], text.alias("text"))


def _lines(section: int, texts: list[str | Column], *order: Column) -> Column:
    return F.array(*[
        _line(section, t if isinstance(t, Column) else F.lit(t), *order, F.lit(i)) for i, t in enumerate(texts)
    ])


def _bullet(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), value.cast("string"))


def markdown(
    sessions: DataFrame, clusters: DataFrame, quotes: DataFrame, alerts: DataFrame, reviews: DataFrame,
    title: str = "Feedback report",
) -> DataFrame:
    """(session_id, markdown) from line rows with a section and an order.

    ``sessions``: session_id, executive_summary, degraded_mode, low_data_mode, the counters of the
    preparation and the diagnostics; ``clusters`` have ``weak``; ``quotes``: session_id,
    cluster_id, quotes; ``reviews`` are listed for low-data sessions only.
    """
    s = F.col
    parts = []

    def add(df: DataFrame, lines: Column) -> None:
        parts.append(df.select(S, F.explode(lines).alias("line")))

    add(sessions, _lines(1, [
        F.concat(F.lit(f"# {title} for "), S), "", "## Executive Summary", "", s("executive_summary"), "", "## Batch Overview", "",
        _bullet("Total records", s("total_records")), _bullet("Reviews kept after preprocessing", s("kept_records")),
        _bullet("Duplicate records removed", s("duplicate_records")),
        _bullet("Reviews quarantined by privacy gate", s("quarantined_records")),
        _bullet("Potential injection attempts", s("injection_hits")),
        _bullet("Low-information reviews", s("low_information_records")),
        _bullet("Degraded mode", yes_no(s("degraded_mode"))),
    ]))
    small = sessions.where("low_data_mode")
    add(small, _lines(2, [
        "", "## Low Data Mode", "",
        f"Warning: fewer than {rules.LOW_DATA_ROWS} reviews were uploaded, so clustering reliability is limited.",
        "Reviews are listed first, and any detected themes are provisional.", "", "## Simple List View", "",
    ]))
    listed = reviews.join(small.select(S), S, "left_semi").select(
        S, _line(3, F.concat(
            F.lit("- `"), "review_id", F.lit("` ["), "source", F.lit("] "), F.date_format("created_at", "yyyy-MM-dd"),
            F.lit(" `"), "language", F.lit("` :: "), "text",
        ), s("raw_index")).alias("line"),
    )
    parts.append(listed)
    add(sessions, _lines(4, [
        "", "## Top Themes", "",
        "| Cluster ID | Label | Reviews | Priority | Sentiment | Trend | Confidence |", "|---|---|---:|---:|---:|---:|---|",
    ]))
    # A session without any top theme shows all of its clusters.
    has_top = F.max(F.when(~s("weak"), 1).otherwise(0)).over(Window.partitionBy(S)) == 1
    shown = top_k(
        clusters.withColumn("_has_top", has_top).where(~s("weak") | ~s("_has_top")), [S], by_priority(), rules.REPORT_THEMES
    ).join(quotes, [S, "cluster_id"], "left")
    two = lambda c: fixed(s(c))
    cells = [F.concat(F.lit("`"), "cluster_id", F.lit("`")), s("label"), s("size").cast("string"), two("priority_score"), two("sentiment_score"), two("trend_delta"), s("confidence")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    parts.append(shown.select(S, _line(5, row, s("rank")).alias("line")))
    add(sessions, _lines(6, ["", "## Theme Detail", ""]))
    named = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("n/a")
    add(shown, _lines(7, [
        F.concat(F.lit("### "), "label", F.lit(" (`"), "cluster_id", F.lit("`)")), "", s("summary"), "",
        _bullet("Keywords", named("keywords")), _bullet("Sources", named("sources")), _bullet("Priority score", two("priority_score")),
        _bullet("Confidence", s("confidence")), _bullet("Degraded reason", F.coalesce("degraded_reason", F.lit("n/a"))), "",
    ], s("rank"), F.lit(0)))
    quoted = shown.where(F.size("quotes") > 0)
    add(quoted, _lines(7, ["Top quotes:"], s("rank"), F.lit(1)))
    add(quoted, F.transform("quotes", lambda q, i: _line(7, F.concat(F.lit('- "'), q, F.lit('"')), s("rank"), F.lit(2), i)))
    add(quoted, _lines(7, [""], s("rank"), F.lit(3)))
    add(sessions, _lines(8, ["## Weak Signals", ""]))
    weak = clusters.where("weak").select(S, F.concat(F.lit("- `"), "cluster_id", F.lit("` "), "label", F.lit(": "), "summary").alias("text"), "priority_score")
    parts.append(weak.select(S, _line(9, s("text"), -s("priority_score")).alias("line")))
    add(sessions.join(weak.select(S).distinct(), S, "left_anti"), _lines(9, ["- No weak-signal clusters were detected in this batch."]))
    add(sessions, _lines(10, ["## Alerts", ""]))
    spikes = gates.material_alerts(alerts)
    ordered = spikes.join(clusters.select(S, "cluster_id", "priority_score"), [S, "cluster_id"], "left").join(
        quotes, [S, "cluster_id"], "left"
    ).withColumn("_order", F.row_number().over(Window.partitionBy(S).orderBy(s("priority_score").desc(), "cluster_id")))
    ratio = F.concat(F.lit(" Spike ratio: "), fixed(s("spike_ratio")), F.lit("."))
    text = F.concat(F.lit("- `"), "cluster_id", F.lit("` ["), "severity", F.lit("] "), "reason", F.coalesce(ratio, F.lit("")))
    parts.append(ordered.select(S, _line(11, text, s("_order"), F.lit(0)).alias("line")))
    add(ordered.where(F.size("quotes") > 0), F.transform(
        F.slice("quotes", 1, 3), lambda q, i: _line(11, F.concat(F.lit('  - "'), q, F.lit('"')), s("_order"), F.lit(1), i)
    ))
    add(sessions.join(spikes.select(S).distinct(), S, "left_anti"), _lines(11, ["- No critical anomaly spikes were detected in the available history."]))
    short = alerts.where("insufficient_history").select(S).distinct()
    add(sessions.join(short, S, "left_semi"), _lines(12, [
        "", "## Notes", "", "- Some clusters do not have enough weekly history for anomaly confirmation yet.",
    ]))
    counts = shown.groupBy(S).agg(F.count("*").alias("_shown"))
    add(sessions.join(counts, S, "left"), _lines(13, [
        "", "## Run Diagnostics", "",
        F.concat(F.lit("- Clustering quality score: "), fixed(s("quality_score"), 3)),
        _bullet("Clustering backend", s("clustering_backend")), _bullet("Selected clustering profile", s("clustering_profile")),
        _bullet("Reflection attempts", s("attempt_count")), _bullet("Total clusters included in report", F.coalesce("_shown", F.lit(0))),
        _bullet("Weak signal clusters", s("weak_signal_cluster_count")),
        _bullet("Mixed sentiment clusters", s("mixed_sentiment_cluster_count")),
        _bullet("Mixed-language reviews", s("mixed_language_review_count")), _bullet("Low data mode", yes_no(s("low_data_mode"))),
        _bullet("Degraded reason", F.coalesce("degraded_reason", F.lit("n/a"))), "",
    ]))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    ordered_text = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"])
    return lines.groupBy(S).agg(
        F.concat(F.btrim(F.array_join(ordered_text, "\n"), F.lit(" \n")), F.lit("\n")).alias("markdown")
    )


def runtime_lines(metadata: DataFrame) -> DataFrame:
    """The markdown appendix of one run: every metadata field of the session as a bullet."""
    names = [c for c in metadata.columns if c != S]
    text = [_bullet(n.replace("_", " ").capitalize(), F.concat(F.lit("`"), F.coalesce(F.col(n).cast("string"), F.lit("n/a")), F.lit("`"))) for n in names]
    return metadata.select(S, F.concat_ws("\n", F.lit("## Runtime Metadata"), F.lit(""), *text, F.lit("")).alias("appendix"))


def with_runtime_defaults(metadata: DataFrame) -> DataFrame:
    """Rows written before a field existed get its default."""
    out = metadata
    for name, default in schemas.RUNTIME_DEFAULTS.items():
        value = F.col(name) if name in out.columns else F.lit(None)
        kind = {"str": "string", "bool": "boolean", "int": "bigint", "float": "double"}[type(default).__name__]
        out = out.withColumn(name, F.coalesce(value.cast(kind), F.lit(default).cast(kind)))
    return out


def runtime_metadata(
    counters: DataFrame, diagnostics: DataFrame, usage: DataFrame, top_ids: DataFrame, settings: dict[str, str]
) -> DataFrame:
    """One row of effective back ends, counts and ids per session.

    ``usage``: session_id, agent, mode, used; ``top_ids``: session_id, top_cluster_ids.
    """
    outside = F.col("used") & ~F.col("mode").isin("local", "fallback", "unknown")
    modes = usage.groupBy(S).agg(F.array_sort(F.collect_set(F.when(outside, F.col("mode")))).alias("_modes"))
    generation = F.when(F.coalesce(F.size("_modes"), F.lit(0)) <= 0, "local").when(F.size("_modes") == 1, F.col("_modes")[0]).otherwise("mixed")
    joined = counters.join(diagnostics, S).join(modes, S, "left").join(top_ids, S, "left")
    return joined.select(
        S,
        F.when(generation == "local", "deterministic").otherwise("llm-enhanced").alias("runtime_profile"),
        F.when(F.col("low_data_mode"), "simple_list").otherwise("clustered").alias("presentation_mode"),
        "low_data_mode", generation.alias("generation_backend_effective"),
        *[F.lit(value).alias(name) for name, value in settings.items()],
        F.col("total_records").alias("records_total"), F.col("kept_records").alias("records_kept"),
        "top_cluster_ids", "weak_signal_cluster_ids",
        F.col("weak_signal_cluster_count").alias("weak_signal_count"),
        "mixed_sentiment_cluster_ids", "mixed_sentiment_cluster_count", "mixed_language_review_count",
    )


def artifacts(sessions: DataFrame, summaries: DataFrame, texts: DataFrame, run_ts: Column) -> DataFrame:
    """Rows of the report table."""
    return sessions.select(S, "degraded_mode").join(summaries, S).join(texts, S).select(
        S, F.concat(F.lit("report_"), S).alias("report_id"), "executive_summary", "markdown",
        run_ts.alias("generated_at"), "degraded_mode",
    )


def session_detail(
    sessions: DataFrame, counters: DataFrame, clusters: DataFrame, alerts: DataFrame, reports: DataFrame, metadata: DataFrame
) -> DataFrame:
    """One row per session with nested clusters, top themes, weak signals, warnings and alerts.

    Review previews may be many and stay a frame of their own (``lookups.preview_cluster``).
    """
    window = Window.partitionBy(S).orderBy(*by_priority())
    item = F.struct("rank", "cluster_id", "label", "size", "priority_score")
    ranked = clusters.withColumn("rank", F.row_number().over(window))
    nested = ranked.groupBy(S).agg(
        F.array_sort(F.collect_list(item)).alias("clusters"),
        F.array_sort(F.collect_list(F.when(~F.col("weak"), item))).alias("top_clusters"),
        F.array_sort(F.collect_list(F.when(F.col("weak"), item))).alias("weak_signals"),
    )
    alerted = alerts.groupBy(S).agg(F.array_sort(F.collect_list(F.struct("alert_id", "severity", "reason"))).alias("alerts"))
    warnings = F.array_compact(F.array(
        F.when(F.col("low_data_mode"), f"Low-data mode is active because fewer than {rules.LOW_DATA_ROWS} reviews were uploaded."),
        F.when(F.size("weak_signals") > 0, F.concat(F.size("weak_signals").cast("string"), F.lit(" weak-signal clusters were excluded from the top themes."))),
    ))
    out = sessions.join(counters, S, "left").join(nested, S, "left").join(alerted, S, "left")
    out = out.join(reports.select(S, "report_id", "executive_summary"), S, "left").join(
        metadata.select(S, "presentation_mode", "low_data_mode"), S, "left"
    )
    return out.withColumn("warnings", warnings).withColumn(
        "presentation_mode", F.coalesce("presentation_mode", F.lit("clustered"))
    )
