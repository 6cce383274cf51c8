"""Terms of the priority score as column expressions (NULL means unknown, never zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .rounding import clamp01, portable_round

TERMS = (
    "demand", "population", "infra_deficit", "vulnerability", "equity",
    "strategic", "urgency", "feasibility", "cost_penalty",
)


def demand_term(reporters: Column, cfg: Settings = DEFAULTS) -> Column:
    n = reporters.cast("double")
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), n / F.lit(float(cfg.demand_saturation))))


def population_term(people: Column, cfg: Settings = DEFAULTS) -> Column:
    p = people.cast("double")
    scaled = F.log1p(p) / F.log1p(F.lit(float(cfg.population_ceiling)))
    return F.when(p <= 0, 0.0).otherwise(F.least(F.lit(1.0), scaled))


def severity_value(severity: Column, cfg: Settings = DEFAULTS) -> Column:
    out = F.lit(cfg.default_severity_deficit)
    for name, value in cfg.severity_deficit.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def severity_deficit(severity: Column, cfg: Settings = DEFAULTS) -> Column:
    """Aggregate: mean severity value of a group, 0 for an empty group."""
    return F.coalesce(F.avg(severity_value(severity, cfg)), F.lit(0.0))


def settlement_proxy(people: Column, settlements: Column, cfg: Settings = DEFAULTS) -> Column:
    size = people.cast("double") / F.nullif(settlements.cast("double"), F.lit(0.0))
    limit = float(cfg.small_settlement)
    small = F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * (F.lit(1.0) - size / F.lit(limit)))
    return (
        F.when(settlements.isNull() | people.isNull() | (settlements <= 0) | (people <= 0), 0.5)
        .when(size >= limit, 0.2)
        .otherwise(small)
    )


def velocity_term(ratio: Column, cfg: Settings = DEFAULTS) -> Column:
    scaled = F.log1p(ratio) / F.log1p(F.lit(cfg.velocity_ceiling))
    return F.when(ratio <= 1.0, 0.0).otherwise(F.least(F.lit(1.0), scaled))


def record_freshness(age_years: Column, cfg: Settings = DEFAULTS) -> Column:
    age = F.greatest(F.lit(0.0), age_years.cast("double"))
    return F.when(age_years.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / F.lit(cfg.trust_half_life_years)))


def gap_score(demand: Column, population: Column, infra: Column, vulnerability: Column,
              cfg: Settings = DEFAULTS) -> Column:
    return (
        F.lit(cfg.w_demand) * demand + F.lit(cfg.w_population) * population
        + F.lit(cfg.w_infra) * infra + F.lit(cfg.w_vulnerability) * vulnerability
    )


def confidence_gate(confidence: Column, has_records: Column | None = None, cfg: Settings = DEFAULTS) -> Column:
    gate = F.when(confidence <= 0, 0.0).otherwise(
        F.least(F.lit(1.0), confidence / F.lit(cfg.confidence_threshold))
    )
    if has_records is None:
        return gate
    return gate * F.when(has_records, 1.0).otherwise(cfg.no_record_factor)


def equity_term(reporting_deficit: Column, block: Column, cfg: Settings = DEFAULTS) -> Column:
    listed = F.when(block.isin(*cfg.low_connectivity_blocks), cfg.equity_points).otherwise(0.0)
    return F.when(
        reporting_deficit.isNotNull(), F.lit(cfg.equity_points) * clamp01(reporting_deficit)
    ).otherwise(listed)


def strategic_term(eligible: Column, people: Column, extra: Column | None = None,
                   cfg: Settings = DEFAULTS) -> Column:
    by_rule = F.when(eligible, cfg.strategic_points).otherwise(0.0)
    by_size = F.when(people >= cfg.strategic_population, cfg.strategic_points).otherwise(0.0)
    base = F.when(eligible.isNotNull(), by_rule).otherwise(by_size)
    return base if extra is None else base + extra


def urgency_term(grade: Column, confidence: Column, cfg: Settings = DEFAULTS) -> Column:
    points = F.lit(cfg.urgency_points) * grade * clamp01(confidence)
    live = (grade > 0) & (confidence > 0)
    return F.when(live, portable_round(points, 2)).otherwise(0.0)


def feasibility_term(distance_km: Column, road_share: Column, cfg: Settings = DEFAULTS) -> Column:
    near, far, w = cfg.feasibility_near_km, cfg.feasibility_far_km, cfg.feasibility_road_weight
    fade = (
        F.when(distance_km <= near, 1.0)
        .when(distance_km >= far, 0.0)
        .otherwise((F.lit(far) - distance_km) / F.lit(far - near))
    )
    mix = F.lit(1.0 - w) * fade + F.lit(w) * F.coalesce(road_share, F.lit(0.5))
    return F.when(distance_km.isNull(), 0.0).otherwise(F.lit(cfg.feasibility_points) * mix)


def cost_penalty(people: Column, cfg: Settings = DEFAULTS) -> Column:
    p = people.cast("double")
    return F.when(p <= 0, 0.0).otherwise(
        F.lit(cfg.cost_penalty_points) * F.least(F.lit(1.0), p / F.lit(float(cfg.cost_penalty_population)))
    )


def category_importance(category: Column, cfg: Settings = DEFAULTS) -> Column:
    if not cfg.use_sector_weights:
        return F.lit(1.0)
    weights = cfg.sector_weights
    top = max(weights.values())
    out = F.lit(sum(weights.values()) / len(weights) / top)
    for name, value in weights.items():
        out = F.when(category == name, value / top).otherwise(out)
    return out


def record_trust(age_years: Column, velocity: Column, high_share: Column, cfg: Settings = DEFAULTS) -> Column:
    """How far a dated record is believed when citizens contradict it now."""
    return F.lit(1.0) - (F.lit(1.0) - record_freshness(age_years, cfg)) * (velocity * high_share)


def trusted_value(real: Column, proxy: Column, trust: Column) -> Column:
    """Record blended with the citizen proxy; the proxy alone when there is no record."""
    blend = clamp01(trust * clamp01(real) + (F.lit(1.0) - trust) * proxy)
    return F.when(real.isNull(), proxy).otherwise(blend)


def percent_text(share: Column) -> Column:
    return F.concat(F.floor(share * 100.0 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def basis_label(real: Column, trust: Column, official: str, other: str, missing: str) -> Column:
    blended = F.concat(
        F.lit("blended:"), percent_text(trust), F.lit("_government_"),
        percent_text(F.lit(1.0) - trust), F.lit("_citizen_" + other),
    )
    return (
        F.when(real.isNull(), missing).when(trust >= 0.95, official).otherwise(blended)
    )


def data_basis(c: dict[str, Column], cfg: Settings = DEFAULTS) -> dict[str, Column]:
    """Source of every term. ``c`` names the score inputs (see ``score_columns``)."""
    infra_trust = record_trust(c["infra_age"], c["velocity"], c["high_share"], cfg)
    vuln_trust = record_trust(c["vuln_age"], c["velocity"], c["high_share"], cfg)
    urgent = urgency_term(c["grade"], c["grade_confidence"], cfg) > 0
    urgency = F.concat(
        F.lit("emergency_"), F.coalesce(c["grade_label"], F.lit("emergency")), F.lit(":"),
        percent_text(c["grade_confidence"]), F.lit("_confidence"),
    )
    return {
        "demand": F.lit("citizen_reports"),
        "population": F.lit("census"),
        "infra_deficit": basis_label(
            c["real_infra"], infra_trust, "government_records", "severity", "proxy_reported_severity"),
        "vulnerability": basis_label(
            c["real_vulnerability"], vuln_trust, "census_deprivation", "vulnerability", "proxy_settlement_size"),
        "equity": F.when(c["reporting_deficit"].isNotNull(), "bharatnet_2022").otherwise("proxy_hardcoded_block_list"),
        "strategic": F.when(c["eligible"].isNotNull(), "published_scheme_rule").otherwise("proxy_population_threshold"),
        "urgency": F.when(urgent, urgency).otherwise("no_emergency"),
        "feasibility": F.when(c["town_km"].isNotNull(), "census_recorded_distance").otherwise("computed_straight_line"),
    }


def score_columns(c: dict[str, Column], cfg: Settings = DEFAULTS) -> dict[str, Column]:
    """Nine rounded terms, their sum, the raw gap score and the gate.

    Inputs: reporters, people, settlements, severity_mean, confidence, category, block, hq_km, velocity,
    high_share, infra_age, vuln_age, real_infra, real_vulnerability, reporting_deficit, eligible, town_km,
    road_share, grade, grade_confidence.
    """
    demand = demand_term(c["reporters"], cfg)
    population = population_term(c["people"], cfg)
    infra = trusted_value(
        c["real_infra"], c["severity_mean"], record_trust(c["infra_age"], c["velocity"], c["high_share"], cfg))
    vulnerability = trusted_value(
        c["real_vulnerability"], settlement_proxy(c["people"], c["settlements"], cfg),
        record_trust(c["vuln_age"], c["velocity"], c["high_share"], cfg))
    has_records = c["real_infra"].isNotNull() & c["real_vulnerability"].isNotNull()
    gate = confidence_gate(c["confidence"], has_records, cfg)
    scale = F.lit(cfg.gap_points) * category_importance(c["category"], cfg) * gate
    distance = F.coalesce(c["town_km"], c["hq_km"])
    road = F.when(c["town_km"].isNotNull(), c["road_share"])
    raw = {
        "demand": F.lit(cfg.w_demand) * demand * scale,
        "population": F.lit(cfg.w_population) * population * scale,
        "infra_deficit": F.lit(cfg.w_infra) * infra * scale,
        "vulnerability": F.lit(cfg.w_vulnerability) * vulnerability * scale,
        "equity": equity_term(c["reporting_deficit"], c["block"], cfg),
        "strategic": strategic_term(c["eligible"], c["people"], cfg=cfg),
        "urgency": urgency_term(c["grade"], c["grade_confidence"], cfg),
        "feasibility": feasibility_term(distance, road, cfg),
        "cost_penalty": -cost_penalty(c["people"], cfg),
    }
    out = {k: portable_round(v, 2) for k, v in raw.items()}
    total = out["demand"]
    for term in TERMS[1:]:
        total = total + out[term]
    out["priority_score"] = portable_round(total, 2)
    out["gap_score"] = portable_round(gap_score(demand, population, infra, vulnerability, cfg), 4)
    out["confidence_gate"] = portable_round(gate, 4)
    return out


def picked_location_confidence(confidence: Column) -> Column:
    return portable_round(F.least(F.lit(1.0), confidence + (F.lit(1.0) - confidence) * 0.5), 2)


def photo_confidence(confidence: Column, worst: Column, supported: Column) -> Column:
    damped = confidence * (F.lit(0.7) + F.lit(0.3) * worst)
    lifted = confidence + (F.lit(1.0) - confidence) * 0.25
    moved = F.when((worst >= 0.85) & supported, lifted).otherwise(damped)
    out = portable_round(F.least(F.lit(1.0), F.greatest(confidence * 0.5, moved)), 4)
    return F.when(confidence.isNull() | worst.isNull(), confidence).otherwise(out)
