"""What an official should know about money before recommending more of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import portable_round

C = F.col


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def _join_parts(*parts: Column) -> Column:
    return F.concat_ws(" - ", *parts)


def school_shortfall() -> Column:
    s = "school_condition."
    return F.coalesce(
        ~C(s + "electricity") | ~C(s + "drinking_water") | (C(s + "toilet_boys_functional") == 0)
        | (C(s + "toilet_girls_functional") == 0)
        | ((F.coalesce(s + "classrooms_major_repair", F.lit(0)) > 0) & (C(s + "classrooms_total") > 0)), F.lit(False))


def has_deficit(category: Column, school: Column) -> Column:
    """A documented shortfall of the category, however funded."""
    road = F.coalesce((C("no_all_weather") > 0) | (C("no_black_top") > 0), F.lit(False))
    water = F.when(C("tap_villages") > 0, C("tap_pct") < 100).otherwise(
        F.coalesce((C("no_treated") > 0) | (C("fails_summer") > 0), F.lit(False)))
    return (
        F.when(category == "road", road).when(category == "water", water).when(category == "education", school)
        .otherwise(False) & (C("records") > 0))


def funding_cautions(scored: DataFrame) -> DataFrame:
    """``caution`` (already_funded / unfunded_need / NULL) and its sentence for scored groups.

    Reads the catchment facts, and for schools total_grant, total_expenditure and school_condition where present.
    """
    from ..operators.catchment import tap_coverage

    has_school = "school_condition" in scored.columns
    school = school_shortfall() if has_school else F.lit(False)
    t = scored.withColumn("tap_pct", portable_round(tap_coverage() * 100.0, 1))
    cat = C("category")
    n, cost, oldest = C("undelivered_works"), C("undelivered_cost_lakh"), C("oldest_undelivered_year")
    road = F.concat(_join_parts(
        F.concat(n.cast("string"), F.lit(" sanctioned PMGSY "), _plural(n, "work", "works"), F.lit(" near this cluster "),
                 _plural(n, "is", "are"), F.lit(" recorded as still undelivered")),
        F.when(cost > 0, F.concat(F.lit("Rs "), F.format_number(cost, 2), F.lit(" lakh already committed"))),
        F.when(oldest.isNotNull(), F.concat(F.lit("oldest sanctioned in "), oldest.cast("string")))),
        F.lit(". Check delivery of the existing sanction before recommending new money."))
    m, rest = C("undelivered_schemes"), C("unspent_estimate_lakh")
    water = F.concat(_join_parts(
        F.concat(m.cast("string"), F.lit(" JJM water "), _plural(m, "scheme", "schemes"), F.lit(" near this cluster "),
                 _plural(m, "is", "are"), F.lit(" recorded as still ongoing")),
        F.when(rest > 0, F.concat(
            F.lit("Rs "), F.format_number(rest, 2), F.lit(" lakh of the estimated cost still unspent")))),
        F.lit(". Check delivery of the existing scheme before recommending new money."))
    grant = C("total_grant") if has_school else F.lit(None).cast("double")
    spent = C("total_expenditure") if has_school else F.lit(None).cast("double")
    left = portable_round(grant - spent, 2)
    paid = grant.isNotNull() | spent.isNotNull()
    money = F.concat(
        F.lit("This school already received Rs "), F.format_number(grant, 0), F.lit(" in UDISE+ grants this year with Rs "),
        F.format_number(left, 0), F.lit(" still unspent against Rs "), F.format_number(spent, 0),
        F.lit(" spent. Check whether the existing grant covers this need before recommending new money."))
    need = has_deficit(cat, school)
    funded = (
        F.when(cat == "road", n > 0).when(cat == "water", (C("schemes_found") > 0) & (m > 0))
        .when(cat == "education", F.coalesce(left > 0, F.lit(False))).otherwise(False))
    # Finished schemes are a record of funding too: silence is right there.
    silent = (cat == "water") & (C("schemes_found") > 0)
    missing = (
        F.when(cat == "road", "No PMGSY-sanctioned work is recorded near this cluster despite a documented road deficiency"
                              " here — this need currently has no funding attached.")
        .when(cat == "water", "No JJM scheme record is found near this cluster despite a documented water deficiency here"
                              " — this need currently has no funding attached.")
        .when(paid, "This school has a UDISE+ grant record but no unspent balance against a documented physical"
                    " deficiency here — this need currently has no additional funding attached.")
        .otherwise("No UDISE+ grant record is found for this school despite a documented physical deficiency here — this"
                   " need currently has no funding attached."))
    caution = F.when(funded, "already_funded").when(need & ~silent, "unfunded_need")
    message = F.when(caution == "already_funded", F.when(cat == "road", road).when(cat == "water", water).otherwise(money)
                     ).when(caution == "unfunded_need", missing)
    return t.withColumns({"caution": caution, "caution_text": message}).drop("tap_pct")
