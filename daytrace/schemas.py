"""Schemas of the tables the jobs read and write, as DDL."""

DAY = """well string, production_date date, on_stream_hours double, oil_volume_sm3 double,
gas_volume_sm3 double, water_volume_sm3 double, well_status string, choke_size double,
choke_unit string, downhole_pressure_bar double, downhole_temperature_c double,
tubing_dp_bar double, annulus_pressure_bar double, wellhead_pressure_bar double,
wellhead_temperature_c double, choke_dp_bar double, source string, parser_version string"""

EVENT = """event_id string, well string, wellbore string, source_document string,
report_date date, start_time timestamp, end_time timestamp, start_raw string,
duration_hours double, activity_code string, category string, subcategory string, state string,
state_detail string, comment string, cause string, evidence_span string, equipment string,
attribution_confidence double, needs_review boolean, review_reasons array<string>,
parser_version string, extractor_version string"""

LABEL = """event_id string, cause string, labeller_pass string, label_source string,
evidence_span string, source_coding_looks_wrong boolean, applied_rule string,
cause_notes string"""

CORRECTION = """event_id string, well string, field string, old_value string, new_value string,
corrected_by string, corrected_at string, extractor_version string, note string"""

REVIEW = """investigation_id string, action string, actor string, recorded_at string,
note string, revision bigint, investigator_version string, protocol_version string"""

ACTIVITY = """dTimStart string, dTimEnd string, proprietaryCode string, state string,
stateDetailActivity string, comments string"""

REPORT = f"drillReport array<struct<activity: array<struct<{ACTIVITY.replace(' string', ': string')}>>>>"
