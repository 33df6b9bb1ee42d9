"""Readers for the clinical source layout (one CSV file per table, with header).

The named columns are found by header name and parsed as their fixed types
(the CSV parser prunes the rest); timestamps are TIMESTAMP_NTZ.  Nothing is
inferred, and a malformed record is an error.  Column names
are lower-cased to the names the operators use.  Ids of stays that can be
missing in event tables are kept as text (they hold float text such as
"123.0") and converted by the operators after their not-null filter.
"""

from __future__ import annotations

import os
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from .files import TIMESTAMP_FORMAT, read_events_csv

# File name and (column, type) of every column read, per table.
TABLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "stays": ("ICUSTAYS.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("ICUSTAY_ID", "bigint"),
                               ("INTIME", "timestamp"), ("OUTTIME", "timestamp"), ("LOS", "double")]),
    "patients": ("PATIENTS.csv", [("SUBJECT_ID", "bigint"), ("GENDER", "string"), ("DOB", "timestamp"),
                                  ("DOD", "timestamp")]),
    "admissions": ("ADMISSIONS.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("ADMISSION_LOCATION", "string"),
                                      ("INSURANCE", "string"), ("MARITAL_STATUS", "string"), ("ETHNICITY", "string"),
                                      ("ADMITTIME", "timestamp"), ("ADMISSION_TYPE", "string"),
                                      ("DISCHTIME", "timestamp")]),
    "services": ("SERVICES.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("TRANSFERTIME", "timestamp"),
                                  ("CURR_SERVICE", "string")]),
    "diagnoses": ("DIAGNOSES_ICD.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("ICD9_CODE", "string")]),
    "procedures": ("PROCEDURES_ICD.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("ICD9_CODE", "string")]),
    "items": ("D_ITEMS.csv", [("ITEMID", "int"), ("LABEL", "string"), ("UNITNAME", "string"), ("LINKSTO", "string")]),
    "outputs": ("OUTPUTEVENTS.csv", [("ICUSTAY_ID", "string"), ("ITEMID", "int"), ("CHARTTIME", "timestamp"),
                                     ("VALUE", "double")]),
    "chart": ("CHARTEVENTS.csv", [("SUBJECT_ID", "bigint"), ("HADM_ID", "bigint"), ("ICUSTAY_ID", "string"),
                                  ("ITEMID", "int"), ("CHARTTIME", "timestamp"), ("VALUENUM", "double")]),
    "meds": ("PRESCRIPTIONS.csv", [("ICUSTAY_ID", "string"), ("DRUG", "string"), ("STARTDATE", "timestamp")]),
}


SPARK_TYPES = {"timestamp": "timestamp_ntz"}


def read_table(spark: SparkSession, path: str, columns: list[tuple[str, str]],
               timestamp_format: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Named columns of a header CSV as their fixed types; a malformed record is an error."""
    schema = ", ".join(f"{name.lower()} {SPARK_TYPES.get(typ, typ)}" for name, typ in columns)
    return read_events_csv(spark, path, schema, options={"timestampNTZFormat": timestamp_format})


def clinical_sources(spark: SparkSession, data_dir: str, timestamp_format: str = TIMESTAMP_FORMAT,
                     file_format: str = "csv") -> SimpleNamespace:
    """All source tables of ``data_dir`` as DataFrames (lazy), by role name:
    stays, patients, admissions, services, diagnoses, procedures, items,
    outputs, chart, meds -- the attributes ``plans.flow.Flow`` reads."""
    tables = {}
    for role, (fname, cols) in TABLES.items():
        path = os.path.join(data_dir, fname)
        if file_format == "csv":
            tables[role] = read_table(spark, path, cols, timestamp_format)
        else:
            tables[role] = spark.read.format(file_format).load(path).select(*[c.lower() for c, _ in cols])
    return SimpleNamespace(**tables)
