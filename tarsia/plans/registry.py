"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarsia.operators import assessment, catalog, evaluation, ingest, mapping, metrics, peers, pilot, publishing, quality, reading, records, rules, scoring, selection, statistics, tuning
from tarsia.plans import assessment_oracles, catalog_oracles, evaluation_oracles, ingest_oracles, more_oracles, oracles, pilot_oracles, publishing_oracles, quality_oracles, reading_oracles, selection_oracles, statistics_oracles, tuning_oracles
from tarsia.sources.projection import Tables

NAMES = {
    "EG01": "fast_closure", "EG02": "ack_no_investigation", "EG03": "no_escalation", "EG04": "template_comments", "EG05": "repeat_no_root_cause", "EG06": "metric_gaming", "EG07": "analyst_capacity",
    "EG08": "unacked_escalation", "EG09": "stale_backlog", "EG10": "kpi_gap", "EG11": "disposition_extremes", "EG12": "skipped_containment", "NS01": "silent_assets", "NS02": "missing_categories",
    "NS03": "low_night_activity", "NS04": "tp_without_case", "NS05": "dormant_rules", "NS06": "ghost_assets", "NS07": "unreported_critical", "NS08": "missing_months",
}


def on_tables(operator: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(Tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"{r.lower()}_{NAMES[r]}": on_tables(f) for r, f in rules.RULES.items()}
QUERIES["findings"] = on_tables(rules.findings)
ORACLES: dict[str, str] = {f"{r.lower()}_{NAMES[r]}": q for r, q in oracles.RULES.items()}

TABLE_QUERIES = {
    "peer_cohorts": peers.cohorts,
    "peer_exclusions": peers.exclusions,
    "local_time_counts": rules.local_counts,
    "domain_scores": scoring.domain_scores,
    "entity_risk_index": scoring.risk_index,
    "rank_controls": scoring.rank_controls,
    "rank_processes": scoring.rank_processes,
    "domain_heatmap": scoring.heatmap,
    "portfolio_summary": scoring.portfolio,
    "review_queue": scoring.review_queue,
    "detection_prf": records.detection_prf,
    "timing_metrics": metrics.timing,
    "workflow_metrics": metrics.workflow,
    "metric_sweep": metrics.sweep,
    "mtta_mttr_scan": metrics.mtta_mttr,
    "kpi_reconciliation": metrics.kpi_reconciliation,
    "usable_counts": metrics.usable,
    "alerts_search": metrics.search,
    "alerts_stats": metrics.stats,
    "monthly_series": metrics.monthly,
    "cusum": metrics.cusum_alarms,
    "blind_signals": metrics.blind_signals,
    "reference_date": rules.reference_date,
    "current_version": lambda t: records.current_version(records.batches(t), ["source", "entity_id", "alert_id"]),
    "as_of_snapshot": lambda t: records.as_of(records.batches(t), 2, ["source", "entity_id", "alert_id"]),
    "entity_merge_latest_nonnull": records.merged_entity,
    "apply_window": lambda t: records.windowed_alerts(t, "2026-01-01", "2026-04-01").select("entity_id", "alert_id", "closed_at", "status", "acknowledged_at", "was_masked"),
    "table_status": records.table_status,
    "table_status_in_window": catalog.window_status,
    "data_fingerprint": records.fingerprint,
    "entity_gate": records.gate_counts,
    "dq_issues": records.dq_issues,
    "dq_summary": records.dq_summary,
    "submitted_tables": catalog.submitted_tables,
    "tables_for_period": catalog.tables_for_period,
    "overlapping_batches": catalog.overlapping_batches,
    "content_hash": catalog.content_hash,
    "auto_register_entity": catalog.auto_registered,
    "cumulative_windows": catalog.cumulative_windows,
    "source_mapping": catalog.mapped_orders,
    "mapping_coverage": catalog.mapping_coverage,
    "parse_values": catalog.parsed_values,
    "rule_result_state": catalog.rule_states,
    "coverage_classification": catalog.coverage,
    "peer_outliers": catalog.peer_outliers,
    "anomaly_scan": catalog.anomaly_scan,
    "seeded_entity_split": catalog.seeded_split,
}
MODULES = (statistics, assessment, evaluation, pilot, ingest, mapping, publishing, selection, reading, quality, tuning)
for module in MODULES:
    TABLE_QUERIES |= module.QUERIES
QUERIES |= {name: on_tables(f) for name, f in TABLE_QUERIES.items()}
QUERIES |= {
    "redact_text": records.redact,
    "norm_hash": records.conversation_hashes,
    "pseudonymise": records.pseudonyms,
    "taxonomy_normalise": records.order_severities,
    "parse_timestamp": records.parsed_times,
    "word_shingles": catalog.turn_similarity,
}
ORACLES |= more_oracles.ORACLES
ORACLES |= catalog_oracles.ORACLES
ORACLES |= statistics_oracles.ORACLES
ORACLES |= assessment_oracles.ORACLES
ORACLES |= evaluation_oracles.ORACLES
ORACLES |= pilot_oracles.ORACLES
ORACLES |= ingest_oracles.ORACLES
ORACLES |= publishing_oracles.ORACLES
ORACLES |= selection_oracles.ORACLES
ORACLES |= reading_oracles.ORACLES
ORACLES |= quality_oracles.ORACLES
ORACLES |= tuning_oracles.ORACLES
