"""Names, money and budgets."""

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..plans import budget, invest
from . import sqltext as S
from .aggregate_queries import OPEN, SCHOOLS
from .registry import query, register

C = F.col

# Free-text place names: spelled right, one letter lost, one added, or something else.
TYPED = """SELECT e.event_id AS id, p.district, CASE e.event_id % 5 WHEN 0 THEN p.name WHEN 1 THEN substr(p.name, 1, 3) || substr(p.name, 5, 20)
  WHEN 2 THEN p.name || 'a' WHEN 3 THEN 'x' || p.name || 'y' ELSE 'Somewhere' END AS name FROM {events} e JOIN {places} p ON p.id = e.user_id"""
TYPED_SQL = TYPED.format(events="events", places="places")
_LEV = "(1e0 - levenshtein(l.name, p.name) / (greatest(length(l.name), length(p.name)) * 1e0)) * 100e0"


@query("jon_18_fuzzy_match", "JON-18", "id:i match_id:i score:d",
       f"""WITH l0 AS ({TYPED_SQL}), l AS (SELECT DISTINCT district, name FROM l0),
           b AS (SELECT * FROM (SELECT l.district, l.name, p.id AS match_id, {_LEV} AS score, row_number() OVER (PARTITION BY l.district, l.name
             ORDER BY {_LEV} DESC, p.id) AS rn FROM l JOIN places p ON p.district = l.district) x WHERE rn = 1 AND score >= 75)
           SELECT l0.id, b.match_id, b.score FROM l0 JOIN b ON b.district = l0.district AND b.name = l0.name""", "places")
def fuzzy_match(v):
    return fuzzy.best_match(v.sql(TYPED), v.places.select("id", "district", "name"), 75.0, strict=False)


def _scored(left: str, right: str) -> str:
    """CTEs: every distinct pair of names of one district (``met``) and its weighted score (``sc``)."""
    return f"""met AS (SELECT DISTINCT l.name AS a, r.name AS b FROM {left} l JOIN {right} r ON r.district = l.district), sc AS {S.weighted('met')}"""


def _best_weighted(left: str, at_least: int) -> str:
    """The best place per row of ``left`` (id, district, name)."""
    return (f"(SELECT id, match_id, score FROM (SELECT l.id, p.id AS match_id, score, row_number() OVER (PARTITION BY l.id ORDER BY score DESC, p.id) AS rn "
            f"FROM {left} l JOIN places p ON p.district = l.district JOIN sc ON sc.a = l.name AND sc.b = p.name) x WHERE rn = 1 AND score >= {at_least})")


@query("jon_18_weighted_ratio", "JON-18", "id:i match_id:i score:d",
       f"""WITH l AS ({TYPED_SQL}), {_scored('l', 'places')} SELECT * FROM {_best_weighted('l', 75)}""", "places")
def fuzzy_strict(v):
    return fuzzy.best_match(v.sql(TYPED), v.places.select("id", "district", "name"), 75.0)


WORK_ENDS = """SELECT w.work_id AS id, p.district, CASE w.work_id % 3 WHEN 0 THEN 'Junction' ELSE p.name || 'x' END AS road_to, p.name AS road_from
  FROM {works} w JOIN {places} p ON p.id = w.place_id"""

@query("jon_18_work_endpoints", "JON-18", "id:i match_id:i score:d match_field:s",
       f"""WITH w AS ({WORK_ENDS.format(works='works', places='places')}), l AS (SELECT id, district, road_to AS name FROM w UNION ALL SELECT id, district, road_from FROM w),
           {_scored('l', 'places')}, a AS {_best_weighted('(SELECT id, district, road_to AS name FROM w)', 80)},
           b AS {_best_weighted('(SELECT id, district, road_from AS name FROM w)', 80)}
           SELECT id, match_id, score, 'road_to' AS match_field FROM a UNION ALL SELECT id, match_id, score, 'road_from' FROM b WHERE id NOT IN (SELECT id FROM a)""",
       "works places")
def work_endpoints(v):
    return fuzzy.match_either(v.sql(WORK_ENDS), v.places.select("id", "district", "name"), 80.0, "road_to", "road_from")


LGD = """SELECT c_custkey + 900000 AS id, p.district, p.block AS subdistrict, CASE c_custkey % 3 WHEN 0 THEN p.name WHEN 1 THEN p.name || 'i' ELSE substr(p.name, 1, 7) END AS name
  FROM {customer} JOIN {places} p ON p.id = c_custkey"""


@query("jon_19_unambiguous_link", "JON-19", "id:i match_id:i score:d",
       f"""WITH r AS ({LGD.format(customer='customer', places='places')}),
           {_scored('places', 'r')},
           s AS (SELECT l.id, r.id AS rid, r.subdistrict, score FROM places l JOIN r ON r.district = l.district JOIN sc ON sc.a = l.name AND sc.b = r.name),
           t AS (SELECT id, max(score) AS top FROM s WHERE score >= 85 GROUP BY id),
           k AS (SELECT s.id, min(rid) AS match_id, max(score) AS score FROM s JOIN t ON t.id = s.id AND s.score = t.top GROUP BY s.id
                 HAVING count(DISTINCT subdistrict) = 1)
           SELECT id, match_id, score FROM k WHERE match_id IN (SELECT match_id FROM k GROUP BY 1 HAVING count(*) = 1)""", "places")
def link(v):
    return fuzzy.unambiguous_link(v.places.select("id", "district", "name"), v.sql(LGD), 85.0, "subdistrict")


_PR = S.hav("p.lat", "p.lon", "r.lat", "r.lon")
VINV = f"""pts AS (SELECT lat, lon, count(*) AS n FROM located WHERE issue_category = 'road' GROUP BY 1, 2),
nr AS (SELECT p.id AS place_id, sum(r.n) AS n FROM places p JOIN pts r ON {_PR} <= 5 GROUP BY 1),
wk AS (SELECT place_id, count(*) AS works, count(*) FILTER (status IN {OPEN}) AS un, coalesce(sum(coalesce(cost_lakh, 0)) FILTER (status IN {OPEN}), 0) AS cost,
       min(sanction_year) FILTER (status IN {OPEN}) AS oldest FROM works WHERE place_id IS NOT NULL GROUP BY 1),
vinv AS (SELECT *, CASE WHEN nearby_reports > 1 AND un > 0 THEN 'funded_undelivered' WHEN nearby_reports > 1 AND works = 0 THEN 'demanded_unfunded'
       WHEN nearby_reports <= 1 AND un > 0 THEN 'funded_not_demanded' ELSE 'no_mismatch' END AS mismatch FROM (
  SELECT p.id AS place_id, p.name AS village, p.district, coalesce(nr.n, 0) AS nearby_reports, coalesce(wk.works, 0) AS works, coalesce(wk.un, 0) AS un,
  coalesce(wk.cost, 0) AS cost, wk.oldest FROM places p LEFT JOIN nr ON nr.place_id = p.id LEFT JOIN wk ON wk.place_id = p.id) x WHERE works > 0 OR nearby_reports > 0)"""


def village_rows(v):
    return invest.village_investment(v.places, v.located, v.works, v.finance)


@query("pip_07_village_money", "PIP-07", "place_id:i nearby_reports:i works:i undelivered_works:i undelivered_cost:d oldest_year:i mismatch:s",
       f"""WITH {VINV} SELECT place_id, nearby_reports, works, un AS undelivered_works, cost AS undelivered_cost, oldest AS oldest_year, mismatch FROM vinv""",
       "places located works")
def village_money(v):
    return village_rows(v)


register("pip_07_unpinned_works", "PIP-07", "unpinned_works:i", lambda v: invest.unpinned_works(v.works),
         "SELECT count(*) AS unpinned_works FROM works WHERE place_id IS NULL", "works")

_FR = S.hav("f.p_lat", "f.p_lon", "r.lat", "r.lon")
SINV = f"""{SCHOOLS}, sr AS (SELECT f.id AS facility_id, count(*) AS n FROM facilities f JOIN located r ON r.issue_category = 'education' AND (r.facility_id = f.id OR {_FR} <= 5)
  WHERE f.category = 'education' GROUP BY 1),
sinv AS (SELECT *, CASE WHEN nearby_reports > 1 AND funded THEN 'funded_undelivered' WHEN nearby_reports > 1 THEN 'demanded_unfunded'
  WHEN funded THEN 'funded_not_demanded' ELSE 'no_mismatch' END AS mismatch FROM (
  SELECT f.id AS facility_id, f.district, coalesce(sr.n, 0) AS nearby_reports, {S.rnd('s.total_grant - s.total_expenditure', 2)} AS unspent_rupees, s.deficit AS infra_deficit,
  coalesce({S.rnd('s.total_grant - s.total_expenditure', 2)} > 0 AND s.deficit > 0, FALSE) AS funded, s.facility_id AS has_row
  FROM facilities f LEFT JOIN sr ON sr.facility_id = f.id LEFT JOIN schools s ON s.facility_id = f.id WHERE f.category = 'education') x
  WHERE nearby_reports > 0 OR has_row IS NOT NULL)"""


def school_table(v):
    return invest.school_investment(v.facilities, v.located, v.school_rows)


@query("pip_08_school_money", "PIP-08", "facility_id:i nearby_reports:i unspent_rupees:d infra_deficit:d mismatch:s",
       f"WITH {SINV} SELECT * FROM sinv", "facilities located school_rows")
def school_money(v):
    return school_table(v)


@query("agg_24_mismatch_counts", "AGG-24", "mismatch:s villages:i schools:i",
       f"""WITH {VINV}, {SINV}, c AS (SELECT unnest(['funded_undelivered', 'demanded_unfunded', 'funded_not_demanded', 'no_mismatch']) AS mismatch)
           SELECT c.mismatch, (SELECT count(*) FROM vinv WHERE vinv.mismatch = c.mismatch) AS villages,
           (SELECT count(*) FROM sinv WHERE sinv.mismatch = c.mismatch) AS schools FROM c""", "places located works facilities school_rows")
def mismatch_counts(v):
    a = invest.class_counts(village_rows(v)).withColumnRenamed("n", "villages")
    return a.join(invest.class_counts(school_table(v)).withColumnRenamed("n", "schools"), "mismatch")


@query("vw_09_investment_alignment", "VW-09", "mismatch:s position:i place_id:i nearby_reports:i undelivered_cost:d",
       f"""WITH {VINV} SELECT * FROM (SELECT mismatch, row_number() OVER (PARTITION BY mismatch ORDER BY cost DESC, nearby_reports DESC, place_id) AS position,
           place_id, nearby_reports, cost AS undelivered_cost FROM vinv WHERE mismatch <> 'no_mismatch') x WHERE position <= 15""", "places located works")
def alignment(v):
    return invest.top_per_class(village_rows(v), [C("undelivered_cost").desc(), C("nearby_reports").desc(), C("place_id")])


@query("vw_09_school_alignment", "VW-09", "mismatch:s position:i facility_id:i nearby_reports:i unspent_rupees:d",
       f"""WITH {SINV} SELECT * FROM (SELECT mismatch, row_number() OVER (PARTITION BY mismatch ORDER BY coalesce(unspent_rupees, 0) DESC, nearby_reports DESC, facility_id) AS position,
           facility_id, nearby_reports, unspent_rupees FROM sinv WHERE mismatch <> 'no_mismatch') x WHERE position <= 15""", "facilities located school_rows")
def school_alignment(v):
    return invest.top_per_class(
        school_table(v), [F.coalesce("unspent_rupees", F.lit(0.0)).desc(), C("nearby_reports").desc(), C("facility_id")])


# Costed assets: one per place, from its works and schemes.
COSTED = """SELECT p.id AS asset_id, CASE p.id % 3 WHEN 0 THEN 'road' WHEN 1 THEN 'water' ELSE 'health' END AS asset_type, p.district,
  w.cost AS undelivered_cost_lakh, p.id % 4 AS undelivered_schemes, (p.id * 37 % 900) / 10e0 AS unspent_estimate_lakh, p.population AS people,
  (p.id * 17 % 1000) / 10e0 AS priority_score FROM {places} p LEFT JOIN (SELECT place_id, floor(sum(cost_lakh) * 8) AS cost FROM {works} GROUP BY 1) w ON w.place_id = p.id"""
_COST = "CASE asset_type WHEN 'road' THEN undelivered_cost_lakh WHEN 'water' THEN CASE WHEN undelivered_schemes > 0 THEN unspent_estimate_lakh END END"
CANDS = f"""costed AS ({COSTED.format(places='places', works='works')}),
cand AS (SELECT asset_id, asset_type, district, cost_lakh, coalesce(people, 0) AS people, priority_score, greatest(1, CAST(round(cost_lakh) AS INT)) AS units
         FROM (SELECT *, {S.rnd(_COST, 2)} AS cost_lakh FROM costed) x WHERE cost_lakh > 0)"""


def cands(v):
    return budget.candidates(v.sql(COSTED))


def scenarios(v):
    """Two objectives for every district, and for all districts together."""
    both = F.explode(F.array(F.lit("population"), F.lit("priority"))).alias("objective")
    local = v.places.select("district").distinct().select(C("district"), F.lit(120.0).alias("budget_lakh"), both)
    whole = v.places.agg(F.lit(None).cast("string").alias("district"), F.lit(900.0).alias("budget_lakh")).select(
        "district", "budget_lakh", both)
    return local.unionByName(whole).withColumn(
        "scenario", F.concat_ws("|", F.coalesce("district", F.lit("all")), "objective"))


@query("pip_09_budget_candidates", "PIP-09", "asset_id:i asset_type:s cost_lakh:d people:i priority_score:d units:i",
       f"WITH {CANDS} SELECT * FROM cand", "places works")
def candidates(v):
    return cands(v)


@query("pip_10_budget_allocation", "PIP-10", "scenario:s asset_id:i cost_lakh:d units:i worth:d")
def allocation(v):
    return budget.allocate(cands(v), scenarios(v))


@query("pip_10_best_value", "PIP-10", "scenario:s worth:d",
       f"""SELECT * FROM (WITH RECURSIVE {CANDS}, sc AS (SELECT d || '|' || o AS scenario, CASE d WHEN 'all' THEN NULL ELSE d END AS district, CASE d WHEN 'all' THEN 900 ELSE 120 END AS cap, o
             FROM (SELECT DISTINCT district AS d FROM places UNION ALL SELECT 'all') x, (SELECT unnest(['population', 'priority']) AS o) y),
           it AS (SELECT sc.scenario, sc.cap, c.*, CASE o WHEN 'population' THEN people * 1e0 ELSE priority_score END AS worth FROM sc JOIN cand c
             ON (sc.district IS NULL OR sc.district = c.district) AND c.units <= sc.cap),
           top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, units ORDER BY worth DESC, asset_id) AS rn FROM it WHERE worth > 0) q
             WHERE rn <= floor(cap / units)),
           nth AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY asset_id) AS i FROM top),
           dp AS (SELECT scenario, cap, 0::BIGINT AS i, list_transform(range(0, cap + 1), lambda c: 0e0) AS best FROM (SELECT DISTINCT scenario, cap FROM nth) z
             UNION ALL SELECT dp.scenario, dp.cap, n.i, list_transform(range(0, dp.cap + 1), lambda c: CASE WHEN c >= n.units
               THEN greatest(dp.best[c + 1], dp.best[c - n.units + 1] + n.worth) ELSE dp.best[c + 1] END) FROM dp JOIN nth n ON n.scenario = dp.scenario AND n.i = dp.i + 1)
           SELECT scenario, arg_max(best[cap + 1], i) AS worth FROM dp GROUP BY scenario) r""", "places works")
def best_value(v):
    return budget.allocate(cands(v), scenarios(v)).groupBy("scenario").agg(F.sum("worth").alias("worth"))


@query("pip_10_upper_bound", "PIP-10", "scenario:s bound:d",
       f"""WITH {CANDS}, sc AS (SELECT d || '|' || o AS scenario, CASE d WHEN 'all' THEN NULL ELSE d END AS district, CASE d WHEN 'all' THEN 900 ELSE 120 END AS cap, o
             FROM (SELECT DISTINCT district AS d FROM places UNION ALL SELECT 'all') x, (SELECT unnest(['population', 'priority']) AS o) y),
           it AS (SELECT sc.scenario, sc.cap, c.*, CASE o WHEN 'population' THEN people * 1e0 ELSE priority_score END AS worth FROM sc JOIN cand c
             ON (sc.district IS NULL OR sc.district = c.district) AND c.units <= sc.cap),
           top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, units ORDER BY worth DESC, asset_id) AS rn FROM it WHERE worth > 0) q
             WHERE rn <= floor(cap / units)),
           run AS (SELECT *, sum(units) OVER (PARTITION BY scenario ORDER BY worth / units DESC, asset_id ROWS UNBOUNDED PRECEDING) - units AS before FROM top)
           SELECT scenario, sum(greatest(0e0, least(1e0, (cap - before) / (units * 1e0))) * worth) AS bound FROM run GROUP BY scenario""", "places works")
def bound(v):
    return budget.upper_bound(cands(v), scenarios(v))


@query("agg_30_allocation_totals", "AGG-30", "scenario:s n_chosen:i total_cost_lakh:d remaining_budget_lakh:d population_reached:i priority_weighted_benefit:d")
def allocation_totals(v):
    return budget.totals(budget.allocate(cands(v), scenarios(v)), scenarios(v))


@query("vw_10_budget_answer", "VW-10", "scenario:s budget_crore:d n_chosen:i total_cost_lakh:d worth:d bound:d")
def budget_answer(v):
    from ..plans.views import budget_answer as answer

    return answer(cands(v), scenarios(v).withColumn("budget_crore", C("budget_lakh") / 100.0).drop("budget_lakh"))
