"""Evidence sentences for people to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

C = F.col


def _text(c: Column) -> Column:
    return c.cast("string")


def _whole(c: Column) -> Column:
    return F.format_number(c, 0)


def _money(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 0))


def _lakh(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2), F.lit(" lakh"))


def _n(c: Column, one: str, many: str) -> Column:
    return F.concat(_text(c), F.when(c == 1, one).otherwise(many))


def school_sentence() -> Column:
    """Teachers, classrooms and money of one school row."""
    staff = [C("teachers_regular"), C("teachers_contract"), C("teachers_part_time")]
    total = sum((F.coalesce(s, F.lit(0)) for s in staff[1:]), F.coalesce(staff[0], F.lit(0)))
    year = F.coalesce(F.concat(F.lit(" ("), F.nullif("year_desc", F.lit("")), F.lit(")")), F.lit(""))
    teachers = F.when(staff[0].isNotNull() | staff[1].isNotNull() | staff[2].isNotNull(),
                      F.concat(_n(total, " teacher", " teachers"), year))
    rooms, good = C("classrooms_total"), C("classrooms_good")
    minor, major = C("classrooms_minor_repair"), C("classrooms_major_repair")

    def repair(n: Column, kind: str) -> Column:
        verb = F.when(rooms.isNotNull() & (n == 1), " needs ").otherwise(" need ")
        return F.when(n > 0, F.concat(_text(n), verb, F.lit(kind + " repair")))

    good_text = F.when(good.isNotNull(), F.concat(
        _text(good), F.when(rooms.isNotNull(), F.concat(F.lit(" of "), _text(rooms))).otherwise(""),
        F.lit(" classrooms good")))
    listed = F.concat_ws(", ", good_text, repair(minor, "minor"), repair(major, "major"))
    classrooms = F.when(listed != "", listed).when(rooms == 0, "0 classrooms")
    money = F.nullif(F.concat_ws(
        ", ", F.concat(F.lit("grant "), _money(C("total_grant"))),
        F.concat(F.lit("spent "), _money(C("total_expenditure")))), F.lit(""))
    joined = F.concat_ws("; ", teachers, classrooms, money)
    empty = F.concat(F.lit("UDISE+ data available ("), F.coalesce("year_desc", F.lit("2024-25")), F.lit(")."))
    return F.when(joined == "", empty).otherwise(F.concat(joined, F.lit(".")))


def _year_head(missing: str) -> Column:
    return F.coalesce(F.concat(F.lit("FY "), F.nullif("fin_year", F.lit("")), F.lit(":")), F.lit(missing))


def finance_sentence() -> Column:
    def part(kind: str) -> Column:
        got, paid = C(kind + "_receipts"), C(kind + "_payments")
        share = F.when((got > 0) & paid.isNotNull() & F.lit(kind == "untied"), F.concat(
            F.lit(" ("), F.format_number(F.least(F.lit(100.0), paid / F.nullif(got, F.lit(0.0)) * 100.0), 0),
            F.lit("% utilised)")))
        return F.when(got.isNotNull() | paid.isNotNull(), F.concat(
            F.lit(kind + " grant "), F.coalesce(_money(got), F.lit("₹0")), F.lit(" received, "),
            F.coalesce(_money(paid), F.lit("₹0")), F.lit(" spent"), F.coalesce(share, F.lit(""))))

    body = F.concat_ws("; ", part("untied"), part("tied"))
    return F.concat(_year_head("PRIASoft finance:"), F.lit(" "), F.when(
        body == "", "PRIASoft accounting records available.").otherwise(F.concat(body, F.lit("."))))


def employment_sentence() -> Column:
    def part(name: str, label: str) -> Column:
        pct = F.coalesce(F.concat(F.lit(" ["), F.format_number(C(name + "_percent"), 0), F.lit("%]")), F.lit(""))
        return F.concat(F.lit(label + " "), _lakh(C(name + "_lakh")), pct)

    total = F.concat(F.lit("MGNREGA expenditure "), _lakh(C("total_lakh")))
    detail = F.concat_ws(", ", part("wages", "wages"), part("material", "material"))
    body = F.concat(F.coalesce(total, F.lit("")), F.when(detail == "", "").otherwise(
        F.concat(F.lit(" ("), detail, F.lit(")"))))
    return F.concat(_year_head("MGNREGA expenditure:"), F.lit(" "), F.when(
        body == "", "MGNREGA accounting records available.").otherwise(F.concat(body, F.lit("."))))


def plan_sentence() -> Column:
    total, done = C("total_panchayats"), C("panchayats_with_plan")
    councils = (
        F.when(total.isNotNull() & (done >= total), F.concat(_whole(total), F.lit(" panchayats, all with a registered plan")))
        .when(total.isNotNull() & done.isNotNull(), F.concat(
            _whole(done), F.lit(" of "), _whole(total), F.lit(" panchayats with a registered plan")))
        .when(total.isNotNull(), F.concat(_whole(total), F.lit(" panchayats"))))
    acts = F.concat(_whole(C("approved_activities")), F.lit(" approved activities"))
    outlay = F.concat(_lakh(C("estimated_outlay_lakh")), F.lit(" estimated outlay"))
    head = F.concat(C("district"), F.lit(" district"), F.coalesce(
        F.concat(F.lit(", FY "), F.nullif("plan_year", F.lit(""))), F.lit("")), F.lit(": "))
    fresh = F.coalesce(F.concat(F.lit(" (data as of "), F.nullif("data_as_of", F.lit("")), F.lit(")")), F.lit(""))
    body = F.concat_ws("; ", councils, acts, outlay)
    return F.concat(head, F.when(body == "", "GPDP data available").otherwise(body), fresh, F.lit("."))


def scheme_sentence() -> Column:
    found, live = C("schemes_found"), C("undelivered_schemes")
    open_text = F.concat(
        _text(live), F.lit(" of "), _text(found), F.lit(" real JJM scheme(s) in this catchment still ongoing, ₹"),
        _text(C("unspent_estimate_lakh")), F.lit(" lakh of the estimated cost unspent"))
    done = F.concat(_text(found), F.lit(" real JJM scheme(s) found in this catchment, all completed"))
    return F.when(found > 0, F.when(live > 0, open_text).otherwise(done))


def water_test_sentence() -> Column:
    return F.when(C("villages_tested") > 0, F.concat(
        _text(C("villages_tested")), F.lit(" of "), _text(C("villages")),
        F.lit(" catchment villages tested this year (JJM WQMIS, current cycle): "), _text(C("samples_total")),
        F.lit(" samples total")))


def employment_catchment_sentence() -> Column:
    years = F.nullif("job_years", F.lit(""))
    return F.when(C("job_villages") > 0, F.concat(
        _text(C("job_villages")), F.lit(" of "), _text(C("villages")),
        F.lit(" catchment villages have a real MGNREGA record ("),
        F.coalesce(F.element_at(F.split(years, ","), -1), F.lit("unknown year")), F.lit("): Rs "),
        F.format_number("job_total_lakh", 2), F.lit(" lakh total expenditure (Rs "),
        F.format_number("job_wages_lakh", 2), F.lit(" lakh wages, Rs "), F.format_number("job_material_lakh", 2),
        F.lit(" lakh material)")))


def flood_sentence(cfg: Settings = DEFAULTS) -> Column:
    n = C("flood_events")
    return F.when(n > 0, F.concat(
        _n(n, " recorded flood-inundation event (", " recorded flood-inundation events ("), C("flood_years"),
        F.lit(f") within {cfg.flood_km:.0f} km, nearest "), _text(C("flood_km")), F.lit(" km away")))


def village_test_sentence() -> Column:
    return F.concat(
        _text(F.coalesce("samples_tested", F.lit(0))), F.lit(" samples tested this year, "),
        _text(F.coalesce("villages_not_tested", F.lit(0))), F.lit(" villages untested nearby"))
