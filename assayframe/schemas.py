"""Schemas of the data model. Readers take these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame

SNAPSHOT = "struct<label:string,kind:string,comparator:string,num:double,text:string,value_string:string,unit:string,reference_interval:string,flag:string>"

TABLES: dict[str, str] = {
    "lab_records": "subject_id bigint, record_id string, lab_report_id string, collection_date date, specimen_type string, laboratory_name string, notes string, created_at timestamp, updated_at timestamp, record_ordinal int",
    "measurements": f"measurement_id string, record_id string, measurement_ordinal int, biomarker_id string, specimen_type string, panel_label string, provenance string, review_state string, original {SNAPSHOT}, current {SNAPSHOT}, source_texts array<string>",
    "corrections": "correction_id string, measurement_id string, corrected_at timestamp, reason string, previous_json string, next_json string, previous_provenance string",
    "catalogue": "biomarker_id string, ordinal int, canonical_label string, canonical_unit string, catalogue_version string, units array<string>, specimens array<string>, method_kind string, allowed_methods array<string>, unsafe_patterns array<string>, unsafe_aliases array<string>",
    "alias": "biomarker_id string, alias string, alias_norm string",
    "unit_conversion": "biomarker_id string, from_unit string, to_unit string, factor double, offset double, source_id string",
    "specimen_group": "biomarker_id string, group_index int, specimen string",
    "method_profile": "biomarker_id string, profile_id string, assay_patterns array<string>, temperature_patterns array<string>, cofactor_patterns array<string>",
    "guidance": "biomarker_id string, guidance_id string, population string, jurisdiction string, sex string, fasting string, purpose string, specimen string, thresholds array<struct<operator:string,value:double,unit:string>>, sources array<string>",
    "observations": "report_id string, page_index int, observation_id string, text string, x double, y double, width double, height double, input_ordinal int, struct_kind string, table_id string, row_index int, column_index int, section_id string",
    "intake_events": "event_id string, event_type string, occurred_at timestamp, local_date date, origin string, provenance string, review_state string, analysis_inclusion string, copied_from_event_id string, created_at timestamp, updated_at timestamp",
    "intake_components": "component_id string, event_id string, canonical_id string, name string, amount double, amount_unit string, unknown_reason string",
    "ledger": "id string, account_id string, kind string, entry_type string, units int, source_id string, grant_source_id string, grant_period_start timestamp, period_end timestamp, created_at timestamp",
}

# The domains of enumerated columns.
DOMAINS: dict[str, tuple[str, ...]] = {
    "specimen_type": ("blood", "serum", "plasma", "urine", "stool", "saliva", "unknown"),
    "kind": ("numeric", "bounded", "categorical", "free_text"),
    "provenance": ("user-entered", "extracted", "user-corrected"),
    "review_state": ("confirmed", "needs-review"),
}


def schema_difference(df: DataFrame, table: str) -> tuple[list[str], list[str]]:
    """(missing, unknown) columns of df against the named table, as `name type`."""
    wanted = {f"{f.name} {f.dataType.simpleString()}" for f in _parsed(df, table)}
    present = {f"{f.name} {f.dataType.simpleString()}" for f in df.schema}
    return sorted(wanted - present), sorted(present - wanted)


def check_schema(df: DataFrame, table: str) -> DataFrame:
    """df with its columns in the table's order; fails on any missing or unknown column, so that nothing slips into an export."""
    missing, unknown = schema_difference(df, table)
    if missing or unknown:
        raise ValueError(f"{table}: missing {missing}, unknown {unknown}")
    return df.select(*[f.name for f in _parsed(df, table)])


def _parsed(df: DataFrame, table: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TABLES[table])
