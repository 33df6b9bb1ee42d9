"""Rule data for cleaning, typing and binning events.

Everything an operator needs to know about item ids, units, plausible
ranges, bins and category spellings lives here as plain data, so the
operators stay generic and the rules can be swapped without touching
code.  The values below are fixed: results only match when they are
exactly these.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# Chart item ids per event type (13 disjoint lists).
# ---------------------------------------------------------------------------
GCS_EYE_OPENING = [184, 220739, 226756, 227011]
GCS_VERBAL_RESPONSE = [723, 223900, 226758, 227014]
GCS_MOTOR_RESPONSE = [454, 223901, 226757, 227012]
GCS_TOTAL = [198, 226755]
DIASTOLIC_BP = [8364, 8368, 8440, 8441, 8502, 8503, 8506, 8555, 220051, 220180, 224643, 225310, 227242]
SYSTOLIC_BP = [6, 51, 442, 455, 3313, 3315, 3321, 6701, 220050, 220179, 224167, 225309, 227243]
MEAN_BP = [52, 443, 456, 2293, 2294, 2647, 3312, 3314, 3320, 6590, 6702, 6927, 7620, 220052, 220181, 225312]
HEART_RATE = [211, 220045, 227018]
FRACTION_INSPIRED_OXYGEN = [189, 190, 727, 1040, 1206, 1863, 2518, 2981, 3420, 3422, 7018, 7041, 7570, 223835,
                            226754, 227009, 227010]
RESPIRATORY_RATE = [614, 615, 618, 619, 651, 653, 1884, 3603, 6749, 7884, 8113, 220210, 224422, 224688, 224689,
                    224690, 226774, 227050]
BODY_TEMPERATURE = [676, 677, 678, 679, 3652, 3654, 6643, 223761, 223762, 226778, 227054]
WEIGHT = [763, 3580, 3581, 3582, 3693, 224639, 226512, 226531]
HEIGHT = [1394, 226707, 226730]

# Items recorded in non-metric units.
BODY_TEMPERATURE_F = [678, 679, 3652, 3654, 6643, 223761, 226778, 227054]
WEIGHT_LB = [3581, 226531]
WEIGHT_OZ = [3582]
HEIGHT_INCH = [1394, 226707]

# Urine output item ids (133 entries with repeats, as given).
URINE_OUTPUT = [
    42810, 43171, 43173, 43175, 43348, 43355, 43365, 43372, 43373, 43374, 43379, 43380, 43431, 43462, 43522, 40405,
    40428, 40534, 40288, 42042, 42068, 42111, 42119, 42209, 41857, 40715, 40056, 40061, 40085, 40094, 40096, 42001,
    42676, 42556, 43093, 44325, 44706, 44506, 42859, 44237, 44313, 44752, 44824, 44837, 43576, 43589, 43633, 44911,
    44925, 42362, 42463, 42507, 42510, 40055, 40057, 40065, 40069, 45804, 45841, 43811, 43812, 43856, 43897, 43931,
    43966, 44080, 44103, 44132, 45304, 46177, 46532, 46578, 46658, 46748, 40651, 43053, 43057, 40473, 42130, 41922,
    44253, 44278, 46180, 44684, 43333, 43347, 42592, 42666, 42765, 42892, 45927, 44834, 43638, 43654, 43519, 43537,
    42366, 45991, 46727, 46804, 43987, 44051, 227489, 226566, 226627, 226631, 45415, 42111, 41510, 40055, 226559,
    40428, 40580, 40612, 40094, 40848, 43685, 42362, 42463, 42510, 46748, 40972, 40973, 46456, 226561, 226567,
    226632, 40096, 40651, 226557, 226558, 40715, 226563,
]

# ---------------------------------------------------------------------------
# Derived rule tables (built from the fixed values above).
# ---------------------------------------------------------------------------

#: event type -> item ids, in labelling order
CHART_TYPES: dict[str, list[int]] = {
    "GCS_EYE_OPENING": GCS_EYE_OPENING,
    "GCS_VERBAL_RESPONSE": GCS_VERBAL_RESPONSE,
    "GCS_MOTOR_RESPONSE": GCS_MOTOR_RESPONSE,
    "GCS_TOTAL": GCS_TOTAL,
    "DIASTOLIC_BP": DIASTOLIC_BP,
    "SYSTOLIC_BP": SYSTOLIC_BP,
    "MEAN_BP": MEAN_BP,
    "HEART_RATE": HEART_RATE,
    "FRACTION_INSPIRED_OXYGEN": FRACTION_INSPIRED_OXYGEN,
    "RESPIRATORY_RATE": RESPIRATORY_RATE,
    "BODY_TEMPERATURE": BODY_TEMPERATURE,
    "WEIGHT": WEIGHT,
    "HEIGHT": HEIGHT,
}

#: the types whose rows are kept by the observation filter (diastolic and
#: systolic ids are typed and range-checked but never selected)
SELECTED_TYPES = [
    "GCS_EYE_OPENING", "GCS_VERBAL_RESPONSE", "GCS_MOTOR_RESPONSE", "GCS_TOTAL", "MEAN_BP", "HEART_RATE",
    "FRACTION_INSPIRED_OXYGEN", "RESPIRATORY_RATE", "BODY_TEMPERATURE", "WEIGHT", "HEIGHT",
]

#: the 90 selected chart item ids, in list order
RELEVANT_IDS: list[int] = [i for t in SELECTED_TYPES for i in CHART_TYPES[t]]

#: unit operations: name -> (item ids, only when value <= threshold or None)
UNIT_RULES: list[tuple[str, list[int]]] = [
    ("f_to_c", BODY_TEMPERATURE_F),
    ("lb_to_kg", WEIGHT_LB),
    ("oz_to_kg", WEIGHT_OZ),
    ("inch_to_cm", HEIGHT_INCH),
    ("frac_to_perc", FRACTION_INSPIRED_OXYGEN),
]

# Plausible ranges after unit conversion.  (types, lo, hi)
# A row of one of the types is removed when value < lo or value > hi.
PLAUSIBLE_RULES: list[tuple[list[str], float | None, float | None]] = [
    (["GCS_TOTAL"], 3.0, None),
    (["DIASTOLIC_BP", "SYSTOLIC_BP", "MEAN_BP"], None, 250.0),
    (["HEART_RATE"], 1.0, 250.0),
    (["FRACTION_INSPIRED_OXYGEN"], None, 100.0),
    (["RESPIRATORY_RATE"], 1.0, 100.0),
    (["BODY_TEMPERATURE"], None, 50.0),
    (["WEIGHT"], None, 700.0),
    (["HEIGHT"], None, 300.0),
]

# Right-closed bin edges and labels per event type.
INF = math.inf
BIN_EDGES: dict[str, list[float]] = {
    "HEART_RATE": [-1, 32.99, 88.5, 106.5, 125.5, INF],
    "RESPIRATORY_RATE": [-1, 5.99, 12.5, 22.5, 30.5, 44.5, INF],
    "BODY_TEMPERATURE": [-1, 33.21, 35.93, 36.39, 36.88, 39.88, INF],
    "MEAN_BP": [-1, 20.64, 50.99, 61.32, 143.44, INF],
    "FRACTION_INSPIRED_OXYGEN": [-1, INF],
    "GCS_TOTAL": [-1, 7, 13, 14, 15],
    "BMI": [-1, 15, 16, 18.5, 25, 30, 35, 40, 45, 50, 60, INF],
    "URINE_OUTPUT": [-1, 670.99, 1426.99, 2543.99, 6896, INF],
}
BIN_LABELS: dict[str, list[str]] = {
    "HEART_RATE": ["CHART_HR_m1", "CHART_HR_n", "CHART_HR_p1", "CHART_HR_p2", "CHART_HR_p3"],
    "RESPIRATORY_RATE": ["CHART_RR_m2", "CHART_RR_m1", "CHART_RR_n", "CHART_RR_p1", "CHART_RR_p2", "CHART_RR_p3"],
    "BODY_TEMPERATURE": ["CHART_BT_m3", "CHART_BT_m2", "CHART_BT_m1", "CHART_BT_n", "CHART_BT_p1", "CHART_BT_p2"],
    "MEAN_BP": ["CHART_BP_m3", "CHART_BP_m2", "CHART_BP_m1", "CHART_BP_n", "CHART_BP_p1"],
    "FRACTION_INSPIRED_OXYGEN": ["CHART_VENT"],
    "GCS_TOTAL": ["CHART_GC_m3", "CHART_GC_m2", "CHART_GC_m1", "CHART_GC_n"],
    "BMI": ["CHART_BM_m3", "CHART_BM_m2", "CHART_BM_m1", "CHART_BM_n", "CHART_BM_p1", "CHART_BM_p2", "CHART_BM_p3",
            "CHART_BM_p4", "CHART_BM_p5", "CHART_BM_p6", "CHART_BM_p7"],
    "URINE_OUTPUT": ["CHART_UO_m3", "CHART_UO_m2", "CHART_UO_m1", "CHART_UO_n", "CHART_UO_p1"],
}
# The binned types, in order (BMI is binned only on request).
BINNED_TYPES = ["HEART_RATE", "RESPIRATORY_RATE", "BODY_TEMPERATURE", "MEAN_BP", "FRACTION_INSPIRED_OXYGEN",
                "GCS_TOTAL", "URINE_OUTPUT"]

# Ordered substring rules for categories (substring, result).
ETHNICITY_RULES = [
    ("WHITE", "WHITE"),
    ("BLACK", "BLACK/AFRICAN AMERICAN"),
    ("ASIAN", "ASIAN"),
    ("HISPANIC", "HISPANIC/LATINO"),
    ("DECLINED", "OTHER/UNKNOWN"),
    ("MULTI", "OTHER/UNKNOWN"),
    ("UNKNOWN", "OTHER/UNKNOWN"),
    ("OTHER", "OTHER/UNKNOWN"),
]
MARITAL_RULES = [
    ("MARRIED", "MARRIED/LIFE PARTNER"),
    ("LIFE PARTNER", "MARRIED/LIFE PARTNER"),
    ("WIDOWED", "WIDOWED/DIVORCED/SEPARATED"),
    ("DIVORCED", "WIDOWED/DIVORCED/SEPARATED"),
    ("SEPARATED", "WIDOWED/DIVORCED/SEPARATED"),
    ("UNKNOWN", "OTHER/UNKNOWN"),
]
MARITAL_NULL_AS = "UNKNOWN"
RARE_CATEGORY = "OTHER/UNKNOWN"
RARE_CODE = "other"
RARE_MIN_COUNT = 100
CATEGORY_COLUMNS = ["admission_location", "insurance", "marital_status", "ethnicity"]

# One-hot baselines that are dropped (after title case).
ONE_HOT_BASELINES = {
    "admission_location": "Emergency Room Admit",
    "insurance": "Medicare",
    "marital_status": "Married/Life Partner",
    "ethnicity": "White",
}
# Static feature name pattern.
STATIC_PATTERN = ("AGE|GENDER_M|LOS|NUM_RECENT_ADMISSIONS|ADMISSION_LOCATION|INSURANCE|MARITAL_STATUS|ETHNICITY"
                  "|PRE_ICU_LOS|ELECTIVE_SURGERY")

# Cohort parameters.
MIN_AGE_YEARS = 18
READMIT_WITHIN_DAYS = 30
EARLY_DEATH_DAYS = 30
RECENT_MIN_DAYS = 1
RECENT_MAX_DAYS = 365
OBSCURED_DOB_YEARS = 209      # 300 - 91
OBSCURED_DOB_DAYS = 146       # 0.4 * 365
OUTPUT_CAP = 10000.0
SPLIT_CUTS = (0.7, 0.8)
SPLIT_SEED = 123
DP_QUANTILE = 1.0
CP_QUANTILE = 0.95
DIAG_PREFIX = "DIAGN_"
PROC_PREFIX = "PROCE_"
DRUG_PREFIX = "PRESC_"
ITEM_LABEL_DROP = ["hr", "kg"]
ITEM_LABEL_KEEP = "nephro"


def bin_rules(include_bmi: bool = False) -> list[tuple[str, float, float, str]]:
    """Flatten the bin edges into (type, lo, hi, label) rows, lo < v <= hi."""
    types = BINNED_TYPES + (["BMI"] if include_bmi else [])
    rows = []
    for t in types:
        edges, labels = BIN_EDGES[t], BIN_LABELS[t]
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            rows.append((t, float(lo), float(hi), lab))
    return rows


def item_rule_rows() -> list[tuple[int, str, str | None, float | None, float | None, bool]]:
    """(itemid, ce_type, unit_op, lo, hi, selected) per typed chart item: the
    per-item view of the lists above (a fixed 116-row table)."""
    ops = {}
    for op, ids in UNIT_RULES:
        for i in ids:
            ops[i] = op
    bounds = {}
    for types, lo, hi in PLAUSIBLE_RULES:
        for t in types:
            bounds[t] = (lo, hi)
    rows = []
    for t, ids in CHART_TYPES.items():
        lo, hi = bounds.get(t, (None, None))
        for i in ids:
            rows.append((i, t, ops.get(i), lo, hi, t in SELECTED_TYPES))
    return rows
