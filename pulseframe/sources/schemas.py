"""The tables' columns and types."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

_TYPES = {t.simpleString(): t for t in (BooleanType(), DateType(), DoubleType(), IntegerType(), StringType(), TimestampType())}


def table(ddl: str) -> StructType:
    """A schema from "name type, name type"; needs no session, other than StructType.fromDDL."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (column.split() for column in ddl.split(","))])


RAW_PRESSURE = table("id string, pressurevalues double, time timestamp, patient_record_id string")

CLEAN_PRESSURE = table("patient_id string, session_id string, time timestamp, pressure_detrend double")

SESSIONS = table(
    """
    patient_id string, session_id string, treatment_id string, session_start timestamp, session_end timestamp, date date
    """
)

LABELLED_PRESSURE = table(
    """
    patient_id string, session_id string, time timestamp, pressure_detrend double, treatment_id string, session_start
    timestamp, prominent_peak boolean, breath_id double, break_id double, set_id double, breath_count double,
    break_count double, set_count double
    """
)

TREATMENTS = table(
    """
    patient_id string, treatment_id string, act_date date, pressures_completeness_score double,
    treatment_day_adherence_score double, breaths_day_adherence_score double, treatment_week_adherence_score double,
    breaths_week_adherence_score double, percent_time_breathing double, mean_breath_amplitude double,
    min_breath_amplitude double, max_breath_amplitude double, sd_breath_amplitude double, mean_breath_duration double,
    min_breath_duration double, max_breath_duration double, sd_breath_duration double, mean_break_duration double,
    min_break_duration double, max_break_duration double, sd_break_duration double, breath_count double, break_count
    double, set_count double, pressures_daily_count double, treatment_start timestamp, treatment_end timestamp,
    treatment_length double, seconds_above10 double, percentage_above10 double
    """
)

ENRICHED_TREATMENTS = StructType(TREATMENTS.fields + table(
    """
    games double, games_played string, phase string, study_email double, age_recruited double, date_recruited date,
    gender string, decimal_age double, day_in_study double, day_of_week string, month double, day_treatment double,
    tr_start_time timestamp, season double, breath_count_is_out boolean
    """
).fields)

DEVICES = table(
    """
    study_email double, acapella int, aerobika int, pep_mask int, pari_pep int, other int, if_other_please_state string,
    number_of_sets int, breaths_per_set int, if_other_please_state__1 string, treatments_per_day int,
    if_other_please_state__2 string, tags string, id int, id1 int, patientId string
    """
)

LINK = table(
    """
    gos_id string, study_email double, study_uid double, date_recruited date, age_recruited int, hub_id string,
    patient_record_id string, date_feedback_start date, date_gaming_start date, date_feedback_end date,
    date_gaming_ended date, date_withdrawn date, date_midpoint_test date
    """
)

HEART = table("userid string, time timestamp, value double")

DAILY = table(
    """
    userid string, date date, step_count double, step_count_q2 double, step_count_q3 double, step_count_q4 double,
    step_count_q234 double, mean_hourly_steps_day double, active_hours double, low_active_hours double,
    active_mins_steps_0 double, active_mins_steps_2 double, active_mins_steps_5 double, active_mins_steps_10 double,
    active_mins_steps_20 double, active_mins_steps_0_ap double, cov_step double, cov_step_q1 double, cov_step_q2 double,
    cov_step_q3 double, cov_step_q4 double, cov_step_q234 double, resting_hr_proxy double, resting_hr_1121 double,
    cov_hr double, cov_hr_q1 double, cov_hr_q2 double, cov_hr_q3 double, cov_hr_q4 double, cov_hr_q5 double,
    mins_wear_total double, mins_wear_623 double, mins_wear_1121 double, mins_wear_q1 double, mins_wear_q2 double,
    mins_wear_q3 double, mins_wear_q4 double, mins_wear_q234 double, wear_percent double, wear_percent_q1 double,
    wear_percent_q2 double, wear_percent_q3 double, wear_percent_q4 double, wear_percent_q234 double, gap_percent
    double, gap_percent_q1 double, gap_percent_q2 double, gap_percent_q3 double, gap_percent_q4 double,
    wear_during_sleep double, step_count_norm double, step_count_norm_q2 double, step_count_norm_q3 double,
    step_count_norm_q4 double, start_window timestamp, end_window timestamp, max_hourly double, min_hourly double,
    median_hourly double, thresh double, thresh_low double, thresh_high double, mvpa_15_prev_method double,
    mvpa_15_prev_method2 double, mvpa_15_prev_method3 double, mvpa_15_prev_method5 double, mvpa_15_prev_method10 double,
    mvpa_15_prev_method20 double, mvpa_15_prev_method_ap_8_21 double, switch_thresh double, switch_thresh_low double,
    switch_thresh_high double, active_mins_hr_steps_thresh double, active_mins_hr_steps_thresh2 double,
    active_mins_hr_steps_thresh3 double, active_mins_hr_steps_thresh5 double, active_mins_hr_steps_thresh10 double,
    active_mins_hr_steps_thresh20 double, step_norm_thresh_mvpa double, step_sedentary_thresh_mvpa double
    """
)

ENRICHED_DAILY = StructType(DAILY.fields + table(
    """
    study_email double, age_recruited double, date_recruited date, gender string, decimal_age double, day_in_study
    double, day_of_week string, week_n double, month double, year double, season double, mvpa_week double,
    mvpa_week_score double, mvpa_15_prev_method_is_out boolean
    """
).fields)
