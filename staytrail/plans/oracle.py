"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each stage is written once as a named CTE with its dependencies; a query's
SQL is ``WITH <needed CTEs in dependency order> <final SELECT>``.  The SQL is
a separate formulation (plain global windows, ``count(*) OVER (PARTITION BY
value)`` for rare values, first-match CASE for ordered rules, character-wise
title case) so that agreement means something.
"""

from __future__ import annotations

from .. import rules
from . import views as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in vals) + "]"


def _in(vals) -> str:
    return "(" + ", ".join(str(v) for v in vals) + ")"


def _case_map(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + " END"


def _first_match(col: str, rule_list) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {_q(n)}) THEN {_q(r)}" for n, r in rule_list) + f" ELSE {col} END"


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({x}, i - 1, 1), '[A-Za-z]') THEN upper(substr({x}, i, 1)) "
            f"ELSE lower(substr({x}, i, 1)) END), '')")


def lump_sql(col: str, n: int, other: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL AND count(*) OVER (PARTITION BY {col}) < {n} THEN {_q(other)} ELSE {col} END"


def fmt_list_sql(x: str, double: bool = False) -> str:
    """Array -> canonical text (ints as-is, doubles with 6 decimals)."""
    if double:
        return f"array_to_string(list_transform({x}, lambda e: printf('%.6f', round_even(e, 6))), ',')"
    return f"array_to_string(list_transform({x}, lambda e: CAST(e AS VARCHAR)), ',')"


D = 86400000000
H = 3600000000
EPOCH = V.EVENT_EPOCH
CUT = V.OBSCURE_CUTOFF_YEAR

CONV = ("CASE "
        f"WHEN itemid IN {_in(rules.BODY_TEMPERATURE_F)} THEN (valuenum - 32.0::DOUBLE) * 5.0::DOUBLE / 9.0::DOUBLE "
        f"WHEN itemid IN {_in(rules.WEIGHT_LB)} THEN valuenum / 2.205::DOUBLE "
        f"WHEN itemid IN {_in(rules.WEIGHT_OZ)} THEN valuenum / 35.274::DOUBLE "
        f"WHEN itemid IN {_in(rules.HEIGHT_INCH)} THEN valuenum * 2.54::DOUBLE "
        f"WHEN itemid IN {_in(rules.FRACTION_INSPIRED_OXYGEN)} AND valuenum <= 1 THEN valuenum * 100.0::DOUBLE "
        "ELSE valuenum END")
TYPE_CASE = "CASE " + " ".join(f"WHEN itemid IN {_in(ids)} THEN {_q(t)}" for t, ids in rules.CHART_TYPES.items()) + " END"
PLAUSIBLE = ("v > 0 AND NOT (ce_type = 'GCS_TOTAL' AND v < 3) "
             "AND NOT (ce_type IN ('DIASTOLIC_BP', 'SYSTOLIC_BP', 'MEAN_BP') AND v > 250) "
             "AND NOT (ce_type = 'HEART_RATE' AND (v < 1 OR v > 250)) "
             "AND NOT (ce_type = 'FRACTION_INSPIRED_OXYGEN' AND v > 100) "
             "AND NOT (ce_type = 'RESPIRATORY_RATE' AND (v < 1 OR v > 100)) "
             "AND NOT (ce_type = 'BODY_TEMPERATURE' AND v > 50) "
             "AND NOT (ce_type = 'WEIGHT' AND v > 700) AND NOT (ce_type = 'HEIGHT' AND v > 300)")


def bin_case(v: str = "valuenum", t: str = "ce_type", include_bmi: bool = False) -> str:
    parts = []
    for typ, edges in rules.BIN_EDGES.items():
        if typ == "BMI" and not include_bmi:
            continue
        for lo, hi, lab in zip(edges[:-1], edges[1:], rules.BIN_LABELS[typ]):
            hi_s = "'inf'::DOUBLE" if hi == float("inf") else f"{float(hi)!r}::DOUBLE"
            parts.append(f"WHEN {t} = {_q(typ)} AND {v} > {float(lo)!r}::DOUBLE AND {v} <= {hi_s} THEN {_q(lab)}")
    return "CASE " + " ".join(parts) + " END"


BINNED_IN = "(" + ", ".join(_q(t) for t in rules.BINNED_TYPES) + ")"

# name -> (dependencies, body)
CTES: dict[str, tuple[list[str], str]] = {}


#: names of tables that are defined by recursion
RECURSIVE: set[str] = set()


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


# -- views --------------------------------------------------------------------
cte("v_stays", [], f"""
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS icustay_id,
       o_orderdate + to_hours(12) AS intime,
       o_orderdate + to_hours(12) + to_days(CAST(1 + o_orderkey % 9 AS INTEGER)) + to_hours(CAST(o_orderkey % 7 AS INTEGER)) AS outtime,
       (1 + o_orderkey % 9) + (o_orderkey % 7) / 24.0::DOUBLE AS los
FROM orders""")

cte("v_patients", [], f"""
SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN c_custkey % 50 = 0 THEN TIMESTAMP '1940-01-01' + to_days(CAST(c_custkey * 97 % 22000 AS INTEGER)) - to_years(300)
            ELSE TIMESTAMP '1940-01-01' + to_days(CAST(c_custkey * 97 % 22000 AS INTEGER)) END AS dob,
       CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1995-06-01' + to_days(CAST(c_custkey * 53 % 2400 AS INTEGER)) END AS dod
FROM customer""")

cte("v_admissions", ["v_stays"], f"""
SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id,
       CASE WHEN o.o_orderkey % 211 = 0 THEN {_q(V.RARE_LOCATION)} ELSE {_case_map('o.o_orderpriority', V.LOCATION_BY_PRIORITY)} END AS admission_location,
       CASE WHEN c.c_custkey % 97 = 0 THEN {_q(V.RARE_INSURANCE)} ELSE {_case_map('c.c_mktsegment', V.INSURANCE_BY_SEGMENT)} END AS insurance,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 'MARRIED' WHEN o.o_orderstatus = 'O' THEN 'SINGLE'
            ELSE {_list(V.MARITAL_OTHER)}[o.o_orderkey % 5 + 1] END AS marital_status,
       {_list(V.ETHNICITIES)}[n.n_nationkey % 12 + 1] AS ethnicity,
       o.o_orderdate + to_hours(CAST((o.o_orderkey % 4) * 5 AS INTEGER)) AS admittime,
       {_list(V.ADMISSION_TYPES)}[o.o_orderkey % 3 + 1] AS admission_type,
       s.outtime AS dischtime
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN v_stays s ON s.hadm_id = o.o_orderkey""")

cte("v_lines", [], """
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_shipdate, p.p_name, p.p_brand, p.p_type, p.p_size, o.o_custkey
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("v_services", ["v_lines"], f"""
SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_shipdate AS transfertime,
       {_case_map('p_type', V.SERVICE_BY_TYPE)} AS curr_service FROM v_lines""")

cte("v_diagnoses", ["v_lines"], """
SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
       CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE ' ' || upper(p_name) || ' ' || CAST(p_size AS VARCHAR) END AS icd9_code
FROM v_lines""")

cte("v_procedures", ["v_lines"], "SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, p_brand AS icd9_code FROM v_lines")

cte("v_items", [], f"""
SELECT CAST(CASE WHEN p_partkey < {len(V.DISTINCT_URINE_IDS)} THEN {_list(V.DISTINCT_URINE_IDS)}[p_partkey + 1]
                 ELSE p_partkey + {V.OTHER_ITEM_IDS} END AS INTEGER) AS itemid,
       CASE WHEN p_partkey % 6 = 5 THEN 'URINE ' || upper(p_name) ELSE {_list(V.ITEM_LABELS)}[p_partkey % 6 + 1] END AS label,
       'ml' AS unitname, 'outputevents' AS linksto
FROM part""")

cte("v_events", [], f"""
SELECT e.event_id, e.ts, e.user_id, e.value, o.o_orderkey, o.o_custkey,
       o.o_orderdate + to_microseconds(date_diff('microsecond', TIMESTAMP '{EPOCH}', e.ts) // 3) AS charttime
FROM events e JOIN orders o ON e.user_id = o.o_orderkey""")

cte("v_chart", ["v_events"], f"""
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(CAST(user_id AS DOUBLE) AS VARCHAR) END AS icustay_id,
       CAST({_list(rules.RELEVANT_IDS)}[event_id % {len(rules.RELEVANT_IDS)} + 1] AS INTEGER) AS itemid,
       charttime, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS valuenum
FROM v_events""")

cte("v_outputs", ["v_events"], f"""
SELECT CASE WHEN event_id % 47 = 0 THEN NULL ELSE CAST(CAST(user_id AS DOUBLE) AS VARCHAR) END AS icustay_id,
       CAST({_list(rules.URINE_OUTPUT)}[event_id % {len(rules.URINE_OUTPUT)} + 1] AS INTEGER) AS itemid,
       charttime,
       CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 29 = 0 THEN -(value * 25)
            WHEN event_id % 31 = 0 THEN 0.0::DOUBLE ELSE value * 25 END AS value
FROM v_events""")

cte("v_meds", [], """
SELECT CASE WHEN l.l_linenumber = 5 AND l.l_partkey % 3 = 0 THEN NULL ELSE CAST(CAST(l.l_orderkey AS DOUBLE) AS VARCHAR) END AS icustay_id,
       CASE WHEN l.l_partkey % 23 = 0 THEN NULL ELSE upper(p.p_name) || ' ' END AS drug,
       l.l_shipdate AS startdate
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")

cte("v_scores", [], """
SELECT l.doc_id, d.source, d.lang, CAST(l.quality AS INTEGER) AS y, (d.n_chars - 4000) / 4000.0::DOUBLE AS logit
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

cte("v_emb", [], """
SELECT vec_id, label AS grp, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec,
       list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS score,
       embedding[1] > -0.5 AS mask
FROM embeddings""")

# -- stage 1: cohort ------------------------------------------------------------
cte("pj", ["v_stays", "v_patients"], f"""
SELECT s.subject_id, s.hadm_id, s.icustay_id, s.intime, s.outtime, s.los, p.gender,
       CASE WHEN year(p.dob) < {CUT} THEN p.dob + to_years({rules.OBSCURED_DOB_YEARS}) - to_days({rules.OBSCURED_DOB_DAYS}) ELSE p.dob END AS dob,
       p.dod
FROM v_stays s JOIN v_patients p ON s.subject_id = p.subject_id""")
cte("alive", ["pj"], "SELECT * FROM pj WHERE NOT coalesce(dod <= outtime, false)")
cte("recent", ["alive"], f"""
SELECT *, CAST(count(*) OVER (PARTITION BY subject_id ORDER BY epoch_us(outtime)
        RANGE BETWEEN {366 * D - 1} PRECEDING AND {D} PRECEDING) AS BIGINT) AS num_recent_admissions
FROM alive""")
cte("aged", ["recent"], f"SELECT *, floor(date_diff('microsecond', dob, outtime) / {D}) / 365.0::DOUBLE AS age FROM recent")
cte("adult", ["aged"], "SELECT * FROM aged WHERE age >= 18")
cte("labelled", ["adult"], f"""
SELECT *, coalesce(days_to_next <= 30, false) AS positive FROM (
  SELECT *, CAST(floor(date_diff('microsecond', outtime, lead(intime) OVER (PARTITION BY subject_id ORDER BY outtime ASC, icustay_id DESC)) / {D}) AS BIGINT) AS days_to_next
  FROM adult)""")
cte("early", ["labelled"], f"SELECT *, coalesce(floor(date_diff('microsecond', outtime, dod) / {D}) <= 30, false) AS early_death FROM labelled")
cte("cbase", ["early"], """
SELECT subject_id, hadm_id, icustay_id, intime, outtime, los, gender, num_recent_admissions, age, positive
FROM early WHERE positive OR NOT early_death""")
cte("cadm0", ["cbase", "v_admissions"], f"""
SELECT b.*, a.admission_location, a.insurance,
       {_first_match("coalesce(a.marital_status, 'UNKNOWN')", rules.MARITAL_RULES)} AS marital_status,
       {_first_match('a.ethnicity', rules.ETHNICITY_RULES)} AS ethnicity, a.admittime, a.admission_type
FROM cbase b LEFT JOIN v_admissions a ON b.subject_id = a.subject_id AND b.hadm_id = a.hadm_id""")
cte("cadm1", ["cadm0"], f"""
SELECT subject_id, hadm_id, icustay_id, intime, outtime, los, gender, num_recent_admissions, age, positive,
       {lump_sql('admission_location', rules.RARE_MIN_COUNT, rules.RARE_CATEGORY)} AS admission_location,
       {lump_sql('insurance', rules.RARE_MIN_COUNT, rules.RARE_CATEGORY)} AS insurance,
       {lump_sql('marital_status', rules.RARE_MIN_COUNT, rules.RARE_CATEGORY)} AS marital_status,
       {lump_sql('ethnicity', rules.RARE_MIN_COUNT, rules.RARE_CATEGORY)} AS ethnicity,
       date_diff('microsecond', admittime, intime) / {D}::DOUBLE AS pre_los, admission_type
FROM cadm0""")
cte("cadm", ["cadm1"], f"""
SELECT subject_id, hadm_id, icustay_id, intime, outtime, los, gender, num_recent_admissions, age, positive,
       {title_sql('admission_location')} AS admission_location, {title_sql('insurance')} AS insurance,
       {title_sql('marital_status')} AS marital_status, {title_sql('ethnicity')} AS ethnicity,
       CASE WHEN pre_los < 0 THEN 0.0::DOUBLE ELSE pre_los END AS pre_icu_los, admission_type
FROM cadm1""")
cte("fserv", ["v_services"], """
SELECT subject_id, hadm_id, transfertime, curr_service, contains(curr_service, 'SURG') OR curr_service = 'ORTHO' AS surgery
FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY transfertime ASC NULLS LAST, curr_service ASC NULLS LAST) AS rn
      FROM v_services) WHERE rn = 1""")
cte("cohort", ["cadm", "fserv"], """
SELECT c.subject_id, c.hadm_id, c.icustay_id, c.intime, c.outtime, c.los, c.gender, c.num_recent_admissions, c.age,
       c.positive, c.admission_location, c.insurance, c.marital_status, c.ethnicity, c.pre_icu_los,
       CAST(coalesce(c.admission_type = 'ELECTIVE' AND f.surgery, false) AS INTEGER) AS elective_surgery
FROM cadm c LEFT JOIN fserv f ON c.subject_id = f.subject_id AND c.hadm_id = f.hadm_id""")

# -- stage 2: codes ---------------------------------------------------------------
cte("codes_raw", ["v_diagnoses", "v_procedures"], f"""
SELECT subject_id, hadm_id, {_q(rules.DIAG_PREFIX)} || lower(trim(icd9_code)) AS icd9_code FROM v_diagnoses
WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL AND icd9_code IS NOT NULL
UNION ALL
SELECT subject_id, hadm_id, {_q(rules.PROC_PREFIX)} || lower(trim(icd9_code)) AS icd9_code FROM v_procedures
WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL AND icd9_code IS NOT NULL""")
cte("codes_adm", ["codes_raw", "v_admissions"], """
SELECT c.subject_id, c.icd9_code, a.admittime, a.dischtime FROM codes_raw c JOIN v_admissions a ON c.hadm_id = a.hadm_id""")
cte("hist", ["cohort", "codes_adm"], f"""
SELECT s.icustay_id, s.subject_id, s.outtime, h.icd9_code, h.admittime, h.dischtime,
       date_diff('microsecond', h.dischtime, s.outtime) / {D}::DOUBLE AS d
FROM cohort s LEFT JOIN codes_adm h ON s.subject_id = h.subject_id
WHERE coalesce(h.admittime <= s.outtime, true)""")
cte("codes_dedup", ["hist"], """
SELECT DISTINCT icustay_id, icd9_code, CASE WHEN d < 0 THEN 0.0::DOUBLE ELSE d END AS days_to_out FROM hist""")
cte("codes", ["codes_dedup"], f"""
SELECT icustay_id, {lump_sql('icd9_code', rules.RARE_MIN_COUNT, rules.RARE_CODE)} AS icd9_code, days_to_out FROM codes_dedup""")

# -- stages 3-5: events -------------------------------------------------------------
cte("chart_obs", ["v_chart"], f"""
SELECT * FROM v_chart WHERE icustay_id IS NOT NULL AND valuenum IS NOT NULL AND itemid IN {_in(rules.RELEVANT_IDS)} AND valuenum > 0""")
cte("chart_conv", ["chart_obs"], f"SELECT *, {CONV} AS v, {TYPE_CASE} AS ce_type FROM chart_obs")
cte("chart_clean", ["chart_conv"], f"""
SELECT subject_id, hadm_id, CAST(CAST(icustay_id AS DOUBLE) AS BIGINT) AS icustay_id, charttime, v AS valuenum, ce_type
FROM chart_conv WHERE {PLAUSIBLE}""")
cte("wh", ["chart_clean"], """
SELECT subject_id, icustay_id, charttime, avg(CASE WHEN ce_type = 'HEIGHT' THEN valuenum END) AS h,
       avg(CASE WHEN ce_type = 'WEIGHT' THEN valuenum END) AS w
FROM chart_clean WHERE ce_type IN ('WEIGHT', 'HEIGHT') GROUP BY subject_id, icustay_id, charttime""")
cte("bmi", ["wh"], """
SELECT subject_id, icustay_id, charttime, w / hf / hf * 10000.0::DOUBLE AS valuenum, 'BMI' AS ce_type FROM (
  SELECT *, coalesce(
    last_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY icustay_id, charttime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(h IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY icustay_id, charttime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS hf
  FROM wh) WHERE w IS NOT NULL AND hf IS NOT NULL""")
cte("gcs_p", ["chart_clean"], """
SELECT subject_id, icustay_id, charttime,
       avg(CASE WHEN ce_type = 'GCS_EYE_OPENING' THEN valuenum END) AS e,
       avg(CASE WHEN ce_type = 'GCS_VERBAL_RESPONSE' THEN valuenum END) AS vr,
       avg(CASE WHEN ce_type = 'GCS_MOTOR_RESPONSE' THEN valuenum END) AS m,
       avg(CASE WHEN ce_type = 'GCS_TOTAL' THEN valuenum END) AS t
FROM chart_clean WHERE ce_type IN ('GCS_EYE_OPENING', 'GCS_VERBAL_RESPONSE', 'GCS_MOTOR_RESPONSE', 'GCS_TOTAL')
GROUP BY subject_id, icustay_id, charttime""")
cte("gcs", ["gcs_p"], """
SELECT subject_id, icustay_id, charttime, coalesce(t, e + vr + m) AS valuenum, 'GCS_TOTAL' AS ce_type
FROM gcs_p WHERE coalesce(t, e + vr + m) IS NOT NULL""")
cte("charts_derived", ["bmi", "gcs", "chart_clean"], """
SELECT icustay_id, charttime, valuenum, ce_type FROM bmi
UNION ALL SELECT icustay_id, charttime, valuenum, ce_type FROM gcs
UNION ALL SELECT icustay_id, charttime, valuenum, ce_type FROM chart_clean
  WHERE ce_type NOT IN ('WEIGHT', 'HEIGHT', 'GCS_EYE_OPENING', 'GCS_VERBAL_RESPONSE', 'GCS_MOTOR_RESPONSE', 'GCS_TOTAL')""")
cte("items_sel", ["v_items"], f"""
SELECT itemid, label FROM (SELECT itemid, lower(label) AS label, unitname, linksto FROM v_items WHERE itemid IN {_in(rules.URINE_OUTPUT)})
WHERE NOT (contains(label, 'hr') OR contains(label, 'kg')) OR contains(label, 'nephro')""")
cte("out_obs", ["v_outputs", "items_sel"], f"""
SELECT CAST(CAST(icustay_id AS DOUBLE) AS BIGINT) AS icustay_id, itemid, charttime, value AS valuenum FROM v_outputs
WHERE itemid IN (SELECT itemid FROM items_sel) AND icustay_id IS NOT NULL AND value IS NOT NULL
  AND itemid IN {_in(rules.URINE_OUTPUT)} AND value > 0""")
cte("out_daily", ["out_obs"], """
SELECT icustay_id, chartday, valuenum, 'URINE_OUTPUT' AS ce_type FROM (
  SELECT icustay_id, CAST(charttime AS DATE) AS chartday, sum(valuenum) AS valuenum
  FROM out_obs WHERE NOT (valuenum > 10000) GROUP BY icustay_id, CAST(charttime AS DATE))
WHERE NOT (valuenum > 10000)""")
cte("out_reduced", ["out_daily", "v_stays"], """
SELECT o.icustay_id, CAST(o.chartday AS TIMESTAMP) + to_hours(12) AS charttime, o.valuenum, o.ce_type FROM out_daily o
WHERE NOT EXISTS (SELECT 1 FROM v_stays s WHERE s.icustay_id = o.icustay_id
                  AND (CAST(s.intime AS DATE) = o.chartday OR CAST(s.outtime AS DATE) = o.chartday))""")
cte("binned", ["charts_derived", "out_reduced"], f"""
SELECT icustay_id, charttime, valuenum, ce_type, {bin_case()} AS valuecat FROM (
  SELECT icustay_id, charttime, valuenum, ce_type FROM charts_derived
  UNION ALL SELECT icustay_id, charttime, valuenum, ce_type FROM out_reduced) WHERE ce_type IN {BINNED_IN}""")
cte("runs", ["binned"], """
SELECT icustay_id, charttime, valuecat, ce_type FROM (
  SELECT *, lag(valuecat) OVER w AS prev, row_number() OVER w AS rn FROM binned
  WINDOW w AS (PARTITION BY ce_type, icustay_id ORDER BY charttime DESC, valuecat ASC NULLS FIRST))
WHERE rn = 1 OR valuecat IS NULL OR prev IS NULL OR valuecat <> prev""")
cte("last_only", ["runs"], """
SELECT icustay_id, charttime, valuecat, ce_type FROM (
  SELECT *, row_number() OVER (PARTITION BY ce_type, icustay_id ORDER BY charttime DESC, valuecat ASC NULLS FIRST) AS rn FROM runs)
WHERE rn = 1""")

# -- stage 6: prescriptions -----------------------------------------------------------
cte("meds_clean", ["v_meds"], f"""
SELECT CAST(CAST(icustay_id AS DOUBLE) AS BIGINT) AS icustay_id,
       {_q(rules.DRUG_PREFIX)} || regexp_replace(lower(drug), '\\s+', '', 'g') AS valuecat, startdate AS charttime
FROM v_meds WHERE icustay_id IS NOT NULL AND drug IS NOT NULL AND startdate IS NOT NULL""")
cte("cp_events", ["runs", "meds_clean"], """
SELECT icustay_id, valuecat, charttime FROM runs UNION ALL SELECT icustay_id, valuecat, charttime FROM meds_clean""")
cte("cp_joined", ["cohort", "cp_events"], f"""
SELECT c.icustay_id, e.valuecat, date_diff('microsecond', e.charttime, c.outtime) / {H}::DOUBLE AS h
FROM cohort c LEFT JOIN cp_events e ON c.icustay_id = e.icustay_id""")
cte("cp_dedup", ["cp_joined"], """
SELECT DISTINCT icustay_id, valuecat, CASE WHEN h < 0 THEN 0.0::DOUBLE ELSE h END AS hours_to_out FROM cp_joined""")
cte("cp", ["cp_dedup"], f"""
SELECT icustay_id, {lump_sql('valuecat', rules.RARE_MIN_COUNT, rules.RARE_CODE)} AS valuecat, hours_to_out FROM cp_dedup""")

# -- stage 7: sequences, arrays, split ---------------------------------------------------
cte("dp_pos", ["codes"], """
SELECT *, CAST(row_number() OVER (PARTITION BY icustay_id ORDER BY days_to_out ASC NULLS LAST, icd9_code ASC NULLS FIRST) - 1 AS INTEGER) AS pos
FROM codes""")
cte("cp_pos", ["cp"], """
SELECT *, CAST(row_number() OVER (PARTITION BY icustay_id ORDER BY hours_to_out ASC NULLS LAST, valuecat ASC NULLS FIRST) - 1 AS INTEGER) AS pos
FROM cp""")
cte("cp_q", ["cp"], f"SELECT quantile_cont(n, {rules.CP_QUANTILE}) AS q FROM (SELECT icustay_id, count(*) AS n FROM cp GROUP BY icustay_id)")
cte("cp_trunc", ["cp_pos", "cp_q"], "SELECT p.* FROM cp_pos p, cp_q WHERE p.pos < cp_q.q")
cte("dict_dp", ["dp_pos"], """
SELECT CAST(row_number() OVER (ORDER BY icd9_code) AS INTEGER) AS idx, icd9_code
FROM (SELECT DISTINCT icd9_code FROM dp_pos WHERE icd9_code IS NOT NULL)""")
cte("dict_cp", ["cp_trunc"], """
SELECT CAST(row_number() OVER (ORDER BY valuecat) AS INTEGER) AS idx, valuecat
FROM (SELECT DISTINCT valuecat FROM cp_trunc WHERE valuecat IS NOT NULL)""")
cte("dp_enc", ["dp_pos", "dict_dp"], """
SELECT p.icustay_id, p.pos, coalesce(d.idx, 0) AS idx, coalesce(p.days_to_out, 0.0::DOUBLE) AS t
FROM dp_pos p LEFT JOIN dict_dp d ON p.icd9_code = d.icd9_code""")
cte("cp_enc", ["cp_trunc", "dict_cp"], """
SELECT p.icustay_id, p.pos, coalesce(d.idx, 0) AS idx, coalesce(p.hours_to_out, 0.0::DOUBLE) AS t
FROM cp_trunc p LEFT JOIN dict_cp d ON p.valuecat = d.valuecat""")
for _p in ("dp", "cp"):
    cte(f"{_p}_arr0", ["cohort", f"{_p}_enc"], f"""
SELECT c.icustay_id,
       list_resize(coalesce(a.codes, []::INTEGER[]), (SELECT max(pos) + 1 FROM {_p}_enc), 0) AS {_p},
       list_resize(coalesce(a.times, []::DOUBLE[]), (SELECT max(pos) + 1 FROM {_p}_enc), 0.0::DOUBLE) AS {_p}_times
FROM cohort c LEFT JOIN (SELECT icustay_id, list(idx ORDER BY pos) AS codes, list(t ORDER BY pos) AS times
                         FROM {_p}_enc GROUP BY icustay_id) a ON c.icustay_id = a.icustay_id""")
    cte(f"{_p}_arrays", [f"{_p}_arr0"], f"""
SELECT a.icustay_id, a.{_p}, list_transform(a.{_p}_times, lambda x: x / m.mx) AS {_p}_times
FROM {_p}_arr0 a, (SELECT max(list_max({_p}_times)) AS mx FROM {_p}_arr0) m""")
cte("split", ["cohort"], f"""
SELECT subject_id, CASE WHEN r < floor({rules.SPLIT_CUTS[0]}::DOUBLE * n) THEN 'train'
                        WHEN r < floor({rules.SPLIT_CUTS[1]}::DOUBLE * n) THEN 'validate' ELSE 'test' END AS split
FROM (SELECT subject_id, row_number() OVER (ORDER BY md5(CAST(subject_id AS VARCHAR) || ':{rules.SPLIT_SEED}'), subject_id) - 1 AS r,
             count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM cohort))""")

# -- scores ----------------------------------------------------------------------------------
cte("scored", ["v_scores"], """
SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p FROM v_scores""")
cte("scored_pred", ["scored"], "SELECT *, CAST(p > 0.5 AS INTEGER) AS pred FROM scored")


def build(final: str, *names: str) -> str:
    """WITH <names and their dependencies, in order> <final>."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    return ("WITH RECURSIVE " if any(n in RECURSIVE for n in order) else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + final
