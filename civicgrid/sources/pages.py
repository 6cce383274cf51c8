"""Tables and cards out of stored HTML pages, one page per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount_and_percent, digits_only, loose_number, safe_float

C = F.col

TABLE = r"(?is)<table[^>]*>(.*?)</table>"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
DATA_CELL = r"(?is)<td[^>]*>(.*?)</td>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def plain(html: Column) -> Column:
    """Tags out, entities for spaces and ampersands resolved, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?s)<[^>]+>", "")
    bare = F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _cells(row: Column, pattern: str = CELL) -> Column:
    return F.transform(_all(row, pattern), plain)


def _cell(i: int) -> Column:
    return F.try_element_at("cells", F.lit(i))


def _rows(pages: DataFrame, table: Column, cell: str = CELL) -> DataFrame:
    """Rows of a table column with their position and their plain cells."""
    return pages.select("*", F.posexplode(_all(table, ROW)).alias("row_no", "_row")).withColumn(
        "cells", _cells(C("_row"), cell)).drop("_row")


def scheme_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Water schemes of a village page: rows of the table headed ``Scheme Id`` with at least nine cells."""
    tables = F.filter(_all(C(html), TABLE), lambda t: t.rlike(r"(?is)<th[^>]*>[^<]*Scheme Id"))
    rows = _rows(pages.withColumn("_t", F.try_element_at(tables, F.lit(1))), C("_t"), DATA_CELL)

    def text(i: int) -> Column:
        return F.nullif(_cell(i), F.lit(""))

    return rows.filter((F.size("cells") >= 9) & text(2).isNotNull()).select(
        *[c for c in pages.columns if c != html], text(2).alias("scheme_id"), _cell(3).alias("scheme_name"),
        text(4).alias("scheme_type"), text(5).alias("scheme_category"), text(6).alias("work_order_date"),
        loose_number(_cell(7)).alias("estimated_lakh"), loose_number(_cell(8)).alias("spent_lakh"),
        text(9).alias("status"))


DEFAULT_FIN_YEAR = "2026-2027"


def expenditure_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """Employment spending per council: the longest table that speaks of councils, numbered rows only."""
    sized = F.transform(
        F.filter(_all(C(html), TABLE), lambda t: t.contains("Panchayat")),
        lambda t, i: F.struct(F.size(_all(t, ROW)).alias("n"), (-i).alias("i"), t.alias("t")))
    year = F.coalesce(
        F.nullif(F.regexp_extract(html, r"(?i)Financial Year\s*([0-9]{4}-[0-9]{4})", 1), F.lit("")),
        F.lit(DEFAULT_FIN_YEAR))
    rows = _rows(pages.withColumns({"_t": F.array_max(sized)["t"], "fin_year": year}), C("_t"))
    numbered = (F.size("cells") >= 5) & _cell(1).rlike("^[0-9]+$") & ~_cell(2).rlike("^[0-9]+$")
    wages, material = amount_and_percent(_cell(4)), amount_and_percent(_cell(5))
    return rows.filter(numbered).select(
        *[c for c in pages.columns if c != html], "fin_year", _cell(1).cast("bigint").alias("serial"),
        _cell(2).alias("panchayat"), safe_float(_cell(3)).alias("total_lakh"), wages[0].alias("wages_lakh"),
        wages[1].alias("wages_percent"), material[0].alias("material_lakh"), material[1].alias("material_percent"))


def _card_value(cards: Column, label: str) -> Column:
    hit = F.filter(cards, lambda c: c["label"] == label)
    return F.try_element_at(hit, F.lit(1))["value"]


def _activities(html: Column, heading: str) -> Column:
    """Ranked rows under a heading: array of rank, name, count."""
    section = F.regexp_extract(
        html, rf"(?is)<h3[^>]*>[^<]*{heading}[^<]*</h3>(.*?)(?=<h3|\z)", 1)
    rows = _all(section, r'(?is)<div class="activity-row">(.*?)</div>')

    def one(row: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_replace(row, r"(?s)<[^>]+>", "\n"), "\n"), lambda p: F.trim(p)), lambda p: p != "")
        three = F.size(parts) >= 3
        return F.struct(
            F.when(three, digits_only(F.try_element_at(parts, F.lit(1)))).alias("rank"),
            F.when(three, F.try_element_at(parts, F.lit(2))).otherwise(F.try_element_at(parts, F.lit(1))).alias("name"),
            F.when(three, digits_only(F.try_element_at(parts, F.lit(3)))).otherwise(
                digits_only(F.try_element_at(parts, F.lit(2)))).alias("count"))

    return F.filter(F.transform(rows, one), lambda a: a["name"].isNotNull())


def district_plan(pages: DataFrame, html: str = "html", code: str = "district_code") -> DataFrame:
    """Stat cards and ranked activities of a district page; a page of another district is rejected."""
    h = C(html)
    shown = F.regexp_extract(h, r'(?is)<input[^>]*id="selectedDistrictCode"[^>]*value="([^"]*)"', 1)
    raw = _all(h, r'(?is)(<h4[^>]*>[^<]*</h4>\s*<[a-z0-9]+[^>]*>[^<]*<)')
    cards = F.transform(raw, lambda c: F.struct(
        plain(F.regexp_extract(c, r"(?is)<h4[^>]*>([^<]*)</h4>", 1)).alias("label"),
        plain(F.regexp_extract(c, r"(?is)</h4>\s*<[a-z0-9]+[^>]*>([^<]*)<", 1)).alias("value")))
    fresh = F.regexp_extract(h, r"(?i)\*?\s*(Data as on[^<]*)", 1)
    t = pages.filter(F.trim(shown) == C(code).cast("string")).withColumn("_cards", cards)
    c = C("_cards")
    return t.select(
        *[x for x in pages.columns if x != html],
        digits_only(_card_value(c, "Total Panchayats")).alias("total_panchayats"),
        digits_only(_card_value(c, "Total Panchayats Registered Plan")).alias("panchayats_with_plan"),
        digits_only(_card_value(c, "Approved Activities")).alias("approved_activities"),
        digits_only(_card_value(c, "Gram Sabhas Conducted")).alias("gram_sabhas_conducted"),
        loose_number(_card_value(c, "Estimated Outlay")).alias("estimated_outlay_lakh"),
        _activities(h, "popular").alias("popular_activities"), _activities(h, "under").alias("underpicked_activities"),
        F.nullif(F.trim(fresh), F.lit("")).alias("data_as_of"))


# Header words of a plan table, in the order they are tried.
PLAN_HEADERS = {
    "work_name": ("work", "activity"), "sector": ("sector", "department"),
    "estimated_cost": ("cost", "amount", "estimate"), "status": ("status", "stage"),
}


def plan_table(rows: DataFrame, key: list[str]) -> DataFrame:
    """Work rows of a plan table whose header names its columns.

    ``rows``: key columns, row_no, cells array<string>. The header is the first row that speaks of works or activities;
    where several columns fit a field the last one counts.
    """
    low = F.transform("cells", F.lower)
    heads = rows.filter(F.exists(low, lambda c: c.contains("work") | c.contains("activity"))).groupBy(*key).agg(
        F.min_by(F.struct(C("row_no").alias("head_no"), low.alias("headers")), "row_no").alias("_h")).select(*key, "_h.*")
    body = rows.join(heads, key).filter((C("row_no") > C("head_no")) & (F.size("cells") >= 2))

    def kind(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(PLAN_HEADERS.items()):
            test = F.lit(False)
            for word in words:
                test = test | h.contains(word)
            out = F.when(test, name).otherwise(out)
        return out

    def field(name: str) -> Column:
        at = F.transform("headers", lambda h, i: F.when(kind(h) == name, i + 1))
        last = F.array_max(F.array_compact(at))
        return F.when(last.isNotNull(), F.try_element_at("cells", last))

    out = body.select(*key, "row_no", *[field(n).alias(n) for n in PLAN_HEADERS])
    return out.withColumn("estimated_cost", safe_float(F.replace("estimated_cost", F.lit(","), F.lit("")))).filter(
        "work_name is not null and work_name <> ''")
