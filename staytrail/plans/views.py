"""Clinical-shaped views over the generated test tables.

The operators of this library take tables shaped like the source data of a
stay-based clinical database (stays, patients, admissions, services, codes,
item dictionary, chart/output events, prescriptions).  The test data is a
star schema of orders, customers, parts, line items and events, so these
views only *rename and re-type* columns (plus a few value mappings and
injected nulls) to give rows in the expected schemas.  They do none of the
operators' work.  The same definitions exist in DuckDB SQL in
``plans/oracle.py``.

Mapping (stand-in rules, fixed):
  stays        orders: subject=o_custkey, stay=hadm=o_orderkey,
               intime=o_orderdate+12h, outtime=intime+(1+k%9)d+(k%7)h
  patients     customer: gender by parity, dob=1940-01-01+(c*97%22000)d, every
               50th 300 years earlier (an obscured age), dod for every 4th
  admissions   orders+customer+nation: admittime=o_orderdate+(k%4)*5h, category
               texts mapped from priority/segment/status/nation
  services     lineitem+part+orders: transfertime=l_shipdate, service from p_type
  diagnoses    lineitem+part+orders: code=' '||upper(p_name)||' '||p_size
  procedures   lineitem+part+orders: code=p_brand
  items        part: the distinct urine item ids for the first part keys, ids in no list for all others
  chart        events+orders: stay=user_id, item = (event_id%90)-th selected id,
               charttime = o_orderdate + (ts - 2024-01-01)/3
  outputs      events+orders: item = (event_id%133)-th urine id, value*25
  meds         lineitem+part: stay=l_orderkey, drug=upper(p_name)||' '
  scores       labels+documents: y=quality, logit=(n_chars-4000)/4000
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

# Stand-in category texts.
LOCATION_BY_PRIORITY = {
    "1-URGENT": "EMERGENCY ROOM ADMIT",
    "2-HIGH": "PHYS REFERRAL/NORMAL DELI",
    "3-MEDIUM": "CLINIC REFERRAL/PREMATURE",
    "4-NOT SPECIFIED": "TRANSFER FROM HOSP/EXTRAM",
    "5-LOW": "** INFO NOT AVAILABLE **",
}
RARE_LOCATION = "TRSF WITHIN THIS FACILITY"
INSURANCE_BY_SEGMENT = {
    "AUTOMOBILE": "Medicare",
    "BUILDING": "Private",
    "FURNITURE": "Medicaid",
    "HOUSEHOLD": "Government",
    "MACHINERY": "Medicare",
}
RARE_INSURANCE = "Self Pay"
MARITAL_BY_STATUS = {"F": "MARRIED", "O": "SINGLE"}
MARITAL_OTHER = ["WIDOWED", "DIVORCED", "SEPARATED", "LIFE PARTNER", "UNKNOWN (DEFAULT)"]
ETHNICITIES = [
    "WHITE", "WHITE - RUSSIAN", "BLACK/AFRICAN AMERICAN", "BLACK/HAITIAN", "ASIAN", "ASIAN - CHINESE",
    "HISPANIC OR LATINO", "HISPANIC/LATINO - PUERTO RICAN", "PATIENT DECLINED TO ANSWER", "MULTI RACE ETHNICITY",
    "UNKNOWN/NOT SPECIFIED", "AMERICAN INDIAN/ALASKA NATIVE",
]
ADMISSION_TYPES = ["ELECTIVE", "EMERGENCY", "URGENT"]
SERVICE_BY_TYPE = {
    "LARGE": "CSURG", "STANDARD": "MED", "MEDIUM": "ORTHO", "PROMO": "NSURG", "SMALL": "CMED", "ECONOMY": "TRAUM",
}
ITEM_LABELS = ["Urine Out Foley", "Urine ml/hr", "Urine Out Nephrostomy hr", "Urine ml/kg", "Void"]
OTHER_ITEM_IDS = 1_000_000  # items beyond: ids that no rule lists
DISTINCT_URINE_IDS = list(dict.fromkeys(rules.URINE_OUTPUT))
EVENT_EPOCH = "2024-01-01 00:00:00"
OBSCURE_CUTOFF_YEAR = 1900


def _map(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr


def _pick(values: list, idx: Column) -> Column:
    """values[idx] for a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _float_text(c: Column) -> Column:
    """Id as the text of a float (how the source files hold gappy ids)."""
    return c.cast("double").cast("string")


def _intime() -> Column:
    return F.timestamp_add("HOUR", F.lit(12), F.col("o_orderdate"))


def _outtime(k: Column) -> Column:
    return F.timestamp_add("HOUR", (k % 7).cast("int"), F.timestamp_add("DAY", (k % 9 + 1).cast("int"), _intime()))


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class TestViews:
    """Lazily built clinical views over one scale-factor folder."""

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- stays / patients / admissions / services -------------------------
    @cached_property
    def stays(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        return o.select(
            F.col("o_custkey").alias("subject_id"), k.alias("hadm_id"), k.alias("icustay_id"),
            _intime().alias("intime"), _outtime(k).alias("outtime"),
            ((k % 9 + 1) + (k % 7) / F.lit(24.0)).alias("los"))

    @cached_property
    def patients(self) -> DataFrame:
        c = self.table("customer")
        ck = F.col("c_custkey")
        dob = F.timestamp_add("DAY", (ck * 97 % 22000).cast("int"), _ntz("1940-01-01 00:00:00"))
        dob = F.when(ck % 50 == 0, F.timestamp_add("YEAR", F.lit(-300), dob)).otherwise(dob)
        dod = F.when(ck % 4 == 0, F.timestamp_add("DAY", (ck * 53 % 2400).cast("int"),
                                                  _ntz("1995-06-01 00:00:00")))
        return c.select(ck.alias("subject_id"),
                        F.when(ck % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
                        dob.alias("dob"), dod.alias("dod"))

    @cached_property
    def admissions(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        k = F.col("o_orderkey")
        location = F.when(k % 211 == 0, F.lit(RARE_LOCATION)).otherwise(_map(F.col("o_orderpriority"),
                                                                              LOCATION_BY_PRIORITY))
        insurance = F.when(F.col("c_custkey") % 97 == 0, F.lit(RARE_INSURANCE)).otherwise(
            _map(F.col("c_mktsegment"), INSURANCE_BY_SEGMENT))
        marital = (F.when(k % 11 == 0, F.lit(None).cast("string"))
                   .when(F.col("o_orderstatus") == "F", F.lit(MARITAL_BY_STATUS["F"]))
                   .when(F.col("o_orderstatus") == "O", F.lit(MARITAL_BY_STATUS["O"]))
                   .otherwise(_pick(MARITAL_OTHER, k % 5)))
        return (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("o_custkey").alias("subject_id"), k.alias("hadm_id"),
                        location.alias("admission_location"), insurance.alias("insurance"),
                        marital.alias("marital_status"),
                        _pick(ETHNICITIES, F.col("n_nationkey") % 12).alias("ethnicity"),
                        F.timestamp_add("HOUR", ((k % 4) * 5).cast("int"), F.col("o_orderdate")).alias("admittime"),
                        _pick(ADMISSION_TYPES, k % 3).alias("admission_type"), _outtime(k).alias("dischtime")))

    def _lines(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
        p = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return li.join(p, li.l_partkey == p.p_partkey).join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def services(self) -> DataFrame:
        return self._lines().select(
            F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
            F.col("l_shipdate").alias("transfertime"), _map(F.col("p_type"), SERVICE_BY_TYPE).alias("curr_service"))

    @cached_property
    def diagnoses(self) -> DataFrame:
        code = F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string")))
        return self._lines().select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
                                    code.alias("icd9_code"))

    @cached_property
    def procedures(self) -> DataFrame:
        return self._lines().select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
                                    F.col("p_brand").alias("icd9_code"))

    # -- items and events --------------------------------------------------
    @cached_property
    def items(self) -> DataFrame:
        p = self.table("part")
        pk = F.col("p_partkey")
        itemid = F.when(pk < len(DISTINCT_URINE_IDS), _pick(DISTINCT_URINE_IDS, pk % len(DISTINCT_URINE_IDS))).otherwise(
            pk + OTHER_ITEM_IDS)
        label = F.when(pk % 6 == 5, F.concat(F.lit("URINE "), F.upper("p_name"))).otherwise(
            _pick(ITEM_LABELS, pk % 6))
        return p.select(itemid.cast("int").alias("itemid"), label.alias("label"),
                        F.lit("ml").alias("unitname"), F.lit("outputevents").alias("linksto"))

    def _events(self) -> DataFrame:
        e = self.table("events").select("event_id", "ts", "user_id", "value")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        shift = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EVENT_EPOCH}', ts) div 3")
        return (e.join(o, e.user_id == o.o_orderkey)
                .withColumn("charttime", F.timestamp_add("MICROSECOND", shift, F.col("o_orderdate"))))

    @cached_property
    def chart(self) -> DataFrame:
        eid = F.col("event_id")
        return self._events().select(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
            F.when(eid % 37 == 0, F.lit(None).cast("string")).otherwise(_float_text(F.col("user_id")))
            .alias("icustay_id"),
            _pick(rules.RELEVANT_IDS, eid % len(rules.RELEVANT_IDS)).cast("int").alias("itemid"),
            "charttime",
            F.when(eid % 41 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("valuenum"))

    @cached_property
    def outputs(self) -> DataFrame:
        eid, v = F.col("event_id"), F.col("value") * 25
        value = (F.when(eid % 43 == 0, F.lit(None).cast("double")).when(eid % 29 == 0, -v)
                 .when(eid % 31 == 0, F.lit(0.0)).otherwise(v))
        return self._events().select(
            F.when(eid % 47 == 0, F.lit(None).cast("string")).otherwise(_float_text(F.col("user_id")))
            .alias("icustay_id"),
            _pick(rules.URINE_OUTPUT, eid % len(rules.URINE_OUTPUT)).cast("int").alias("itemid"),
            "charttime", value.alias("value"))

    @cached_property
    def meds(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
        p = self.table("part").select("p_partkey", "p_name")
        stay = F.when((F.col("l_linenumber") == 5) & (F.col("l_partkey") % 3 == 0), F.lit(None).cast("string")) \
            .otherwise(_float_text(F.col("l_orderkey")))
        drug = F.when(F.col("l_partkey") % 23 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.upper("p_name"), F.lit(" ")))
        return li.join(p, li.l_partkey == p.p_partkey).select(
            stay.alias("icustay_id"), drug.alias("drug"), F.col("l_shipdate").alias("startdate"))

    # -- model scores ------------------------------------------------------
    @cached_property
    def scores(self) -> DataFrame:
        lab, doc = self.table("labels"), self.table("documents").select("doc_id", "n_chars", "source", "lang")
        return lab.join(doc, "doc_id").select(
            "doc_id", "source", "lang", F.col("quality").cast("int").alias("y"),
            ((F.col("n_chars") - 4000) / F.lit(4000.0)).alias("logit"))

    @cached_property
    def embeddings(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select("vec_id", F.col("label").alias("grp"),
                        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("score"),
                        (F.element_at("embedding", 1) > F.lit(-0.5)).alias("mask"))
