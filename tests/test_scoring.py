import math

import pytest
from pyspark.sql import functions as F

from civicgrid.functions import numeric
from civicgrid.functions.numeric import TERMS

C = F.col
SCHEMA = (
    "id int, reporters int, people int, settlements int, severity_mean double, confidence double, category string, "
    "block string, hq_km double, velocity double, high_share double, infra_age double, vuln_age double, "
    "real_infra double, real_vulnerability double, reporting_deficit double, eligible boolean, town_km double, "
    "road_share double, grade double, grade_label string, grade_confidence double")
BASE = dict(
    reporters=10, people=20000, settlements=4, severity_mean=0.5, confidence=0.9, category="road", block="Kagal",
    hq_km=5.0, velocity=0.0, high_share=0.0, infra_age=None, vuln_age=None, real_infra=None, real_vulnerability=None,
    reporting_deficit=None, eligible=None, town_km=None, road_share=None, grade=0.0, grade_label=None,
    grade_confidence=0.0)


def score(spark, *variants):
    rows = [{"id": i, **BASE, **v} for i, v in enumerate(variants)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    inputs = {c: C(c) for c in df.columns if c != "id"}
    out = df.select("id", *[x.alias(n) for n, x in numeric.score_columns(inputs).items()],
                    *[x.alias("basis_" + n) for n, x in numeric.data_basis(inputs).items()])
    return [r.asDict() for r in out.orderBy("id").collect()]


def test_terms_sum_to_score(spark):
    for r in score(spark, {}, {"grade": 1.0, "grade_confidence": 0.4}, {"real_infra": 0.8, "real_vulnerability": 0.3}):
        assert math.isclose(sum(r[t] for t in TERMS), r["priority_score"], abs_tol=0.006)
        assert -3 <= r["priority_score"] <= 100


def test_demand_saturates_and_gate_damps(spark):
    few, many, more, shaky = score(spark, {"reporters": 5}, {"reporters": 25}, {"reporters": 500}, {"confidence": 0.3})
    assert few["demand"] < many["demand"] == more["demand"]
    assert 0 < shaky["demand"] < score(spark, {})[0]["demand"]


def test_equity_can_flip_a_ranking(spark):
    loud, quiet = score(spark, {"reporters": 14}, {"reporters": 9, "block": "Chandgad"})
    assert quiet["priority_score"] > loud["priority_score"] and quiet["equity"] == 10.0


def test_records_replace_proxies_and_missing_records_cost_confidence(spark):
    proxy, real = score(spark, {"confidence": 0.75}, {"confidence": 0.75, "real_infra": 0.5, "real_vulnerability": 0.2})
    assert proxy["confidence_gate"] == 0.85 and real["confidence_gate"] == 1.0
    assert real["basis_infra_deficit"] == "government_records"
    assert proxy["basis_infra_deficit"] == "proxy_reported_severity"


def test_trust_blend_moves_towards_citizens_only_when_they_contradict(spark):
    calm, loud = score(
        spark, {"real_infra": 0.1, "infra_age": 15.0, "severity_mean": 1.0},
        {"real_infra": 0.1, "infra_age": 15.0, "severity_mean": 1.0, "velocity": 1.0, "high_share": 1.0})
    assert loud["infra_deficit"] > calm["infra_deficit"]
    assert loud["basis_infra_deficit"].startswith("blended:35%_government_65%")


def test_urgency_is_capped_and_needs_a_grade(spark):
    none, full = score(spark, {"grade_confidence": 1.0}, {"grade": 1.0, "grade_confidence": 3.0, "grade_label": "collapse"})
    assert none["urgency"] == 0.0 and full["urgency"] == 15.0


@pytest.mark.parametrize("km, share, want", [(5.0, 1.0, 2.0), (45.0, None, 0.3), (None, 1.0, 0.0)])
def test_feasibility(spark, km, share, want):
    df = spark.createDataFrame([(km, share)], "km double, share double")
    got = df.select(numeric.feasibility_term(C("km"), C("share"))).first()[0]
    assert math.isclose(got, want)
