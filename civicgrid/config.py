"""Settings of a run. Every operator takes a ``Settings`` so one run can override any value."""

from __future__ import annotations

from dataclasses import dataclass, field

EARTH_KM = 6371.0
PHOTO_EARTH_KM = 6371.0088

CATEGORIES = ("road", "water", "health", "education")


@dataclass(frozen=True)
class Settings:
    """Fixed values of the scoring model; they must equal the published model for equal results."""

    # grouping
    gate_km: float = 8.0
    eps_km: float = 6.0
    min_samples: int = 3
    semantic_km: float = 3.0
    work_group_m: float = 250.0
    asset_group_m: float = 250.0

    # catchments
    catchment_km: dict = field(
        default_factory=lambda: {"road": 5.0, "water": 3.0, "health": 8.0, "education": 4.0}
    )
    default_catchment_km: float = 4.0

    # gap score
    w_demand: float = 0.25
    w_population: float = 0.25
    w_infra: float = 0.25
    w_vulnerability: float = 0.25
    gap_points: float = 69.0
    demand_saturation: int = 25
    population_ceiling: int = 100_000
    severity_deficit: dict = field(default_factory=lambda: {"high": 1.0, "medium": 0.5, "low": 0.2})
    default_severity_deficit: float = 0.5
    small_settlement: int = 2000

    # adjustments
    confidence_threshold: float = 0.75
    no_record_factor: float = 0.85
    equity_points: float = 10.0
    strategic_points: float = 4.0
    urgency_points: float = 15.0
    feasibility_points: float = 2.0
    cost_penalty_points: float = 3.0
    strategic_population: int = 5000
    feasibility_near_km: float = 15.0
    feasibility_far_km: float = 45.0
    feasibility_road_weight: float = 0.3
    cost_penalty_population: int = 50_000
    velocity_ceiling: float = 20.0
    burst_hours: float = 72.0
    trust_half_life_years: float = 10.0
    low_connectivity_blocks: tuple = (
        "Chandgad", "Ajra", "Gaganbawada", "Radhanagari", "Shahuwadi", "Bhudargad",
        "Surgana", "Peth", "Trimbakeshwar", "Kalwan",
    )
    sector_weights: dict = field(
        default_factory=lambda: {"health": 0.30, "education": 0.30, "water": 0.20, "road": 0.10}
    )
    use_sector_weights: bool = False

    # emergency fusion
    grade_collapse: float = 1.0
    grade_partial: float = 2.0 / 3.0
    grade_crack: float = 1.0 / 3.0
    wording_single: float = 0.40
    wording_corroborated: float = 0.50
    burst_cap: float = 0.30
    hazard_alert: float = 0.20
    hazard_river: float = 0.15
    hazard_cap: float = 0.30
    photo_cap: float = 0.40

    # norms of the registers
    road_min_population: int = 500
    people_per_subcentre: int = 5000
    people_per_phc: int = 30_000
    upper_primary_km: float = 3.0
    full_tap_coverage: float = 100.0
    impaired_statuses: tuple = (
        "DOWN", "UNKNOWN PREV DOWN", "NO_STATUS_RECORDED", "#N/A", "NOT VISIBLE IN NOC",
    )
    undelivered_statuses: tuple = ("Not Started", "In Progress", "Agreement Cancelled")
    undelivered_scheme_statuses: tuple = ("ongoing", "in progress", "not started")
    baseline_year: int = 2011
    tap_coverage_year: int = 2024

    # places, pins and assets
    pin_max_km: float = 5.0
    snap_m: float = 300.0
    health_nearest_km: float = 8.0
    school_radius_m: float = 2000.0
    shortlist: int = 6
    facility_max_km: float = 10.0
    public_decimals: int = 3
    flood_km: float = 5.0
    groundwater_km: float = 25.0
    fibre_km: float = 15.0
    river_km: float = 25.0
    road_snap_m: float = 500.0

    # money
    demand_radius_km: float = 5.0
    low_demand: int = 1
    cost_step_lakh: float = 1.0

    # photos
    capture_max_km: float = 5.0
    capture_max_accuracy_m: float = 1000.0
    capture_max_age_min: float = 120.0
    phash_max: int = 8
    dhash_max: int = 12
    ela_flag: float = 0.55
    moire_flag: float = 0.6
    defect_threshold: float = 0.25
    min_box_area: float = 0.005
    authenticity_floor: float = 0.2


DEFAULTS = Settings()
