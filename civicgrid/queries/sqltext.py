"""SQL fragments shared by the checks."""


def rnd(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5e0) / 1e{n})"


def hav(a: str, b: str, c: str, d: str, r: float = 6371.0) -> str:
    return (
        f"(2 * {r}e0 * asin(sqrt(least(1e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
        f" * pow(sin(radians({d} - {b}) / 2), 2)))))"
    )


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


DEMAND = "CASE WHEN reporters <= 0 THEN 0e0 ELSE least(1e0, reporters / 25e0) END"
POPULATION = "CASE WHEN people <= 0 THEN 0e0 ELSE least(1e0, ln(1 + people) / ln(100001)) END"
SEVERITY = "CASE severity WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.5e0 WHEN 'low' THEN 0.2e0 ELSE 0.5e0 END"
SETTLEMENT = (
    "CASE WHEN people IS NULL OR settlements IS NULL OR settlements <= 0 OR people <= 0 THEN 0.5e0"
    " WHEN people * 1e0 / settlements >= 2000 THEN 0.2e0"
    " ELSE least(1e0, 0.2e0 + 0.8e0 * (1 - people * 1e0 / settlements / 2000)) END"
)
VELOCITY = "CASE WHEN {r} <= 1 THEN 0e0 ELSE least(1e0, ln(1 + {r}) / ln(21)) END"
FRESH = "CASE WHEN {a} IS NULL THEN 1e0 ELSE pow(0.5e0, greatest(0e0, {a}) / 10e0) END"
GATE = "CASE WHEN confidence <= 0 THEN 0e0 ELSE least(1e0, confidence / 0.75e0) END"
BLOCKS = (
    "('Chandgad', 'Ajra', 'Gaganbawada', 'Radhanagari', 'Shahuwadi', 'Bhudargad', 'Surgana', 'Peth',"
    " 'Trimbakeshwar', 'Kalwan')"
)
EQUITY = (
    f"CASE WHEN reporting_deficit IS NOT NULL THEN 10e0 * {clamp('reporting_deficit')}"
    f" WHEN block IN {BLOCKS} THEN 10e0 ELSE 0e0 END"
)
STRATEGIC = (
    "CASE WHEN eligible IS NOT NULL THEN CASE WHEN eligible THEN 4e0 ELSE 0e0 END"
    " WHEN people >= 5000 THEN 4e0 ELSE 0e0 END"
)
URGENCY = (
    "CASE WHEN grade > 0 AND grade_confidence > 0 THEN "
    + rnd("15e0 * grade * " + clamp("grade_confidence"), 2) + " ELSE 0e0 END"
)
FEAS = (
    "CASE WHEN {d} IS NULL THEN 0e0 ELSE 2e0 * (0.7e0 * CASE WHEN {d} <= 15 THEN 1e0 WHEN {d} >= 45 THEN 0e0"
    " ELSE (45 - {d}) / 30e0 END + 0.3e0 * coalesce({s}, 0.5e0)) END"
)
PENALTY = "CASE WHEN people <= 0 THEN 0e0 ELSE 3e0 * least(1e0, people / 50000e0) END"
TRUST = "(1 - (1 - ({fresh})) * (velocity * high_share))"


def trust(age: str) -> str:
    return TRUST.replace("{fresh}", FRESH.replace("{a}", age))


def blend(real: str, proxy: str, age: str) -> str:
    t = trust(age)
    return f"CASE WHEN {real} IS NULL THEN {proxy} ELSE {clamp(f'{t} * {clamp(real)} + (1 - {t}) * ({proxy})')} END"


def pct(x: str) -> str:
    return f"(cast(cast(floor(({x}) * 100e0 + 0.5e0) AS BIGINT) AS VARCHAR) || '%')"


def basis(real: str, age: str, official: str, other: str, missing: str) -> str:
    t = trust(age)
    return (
        f"CASE WHEN {real} IS NULL THEN '{missing}' WHEN {t} >= 0.95e0 THEN '{official}' ELSE 'blended:' || {pct(t)}"
        f" || '_government_' || {pct('1 - ' + t)} || '_citizen_{other}' END"
    )


def score_sql(source: str, keys: str, severity_mean: str) -> str:
    """Nine terms over a relation with the score inputs as columns (``infra_age``/``vuln_age`` included)."""
    gate = f"(({GATE}) * CASE WHEN real_infra IS NULL OR real_vulnerability IS NULL THEN 0.85e0 ELSE 1e0 END)"
    infra = blend("real_infra", severity_mean, "infra_age")
    vuln = blend("real_vulnerability", SETTLEMENT, "vuln_age")
    feas = FEAS.replace("{d}", "coalesce(town_km, hq_km)").replace(
        "{s}", "CASE WHEN town_km IS NULL THEN NULL ELSE road_share END")
    parts = {
        "demand": f"0.25e0 * ({DEMAND}) * (69e0 * {gate})", "population": f"0.25e0 * ({POPULATION}) * (69e0 * {gate})",
        "infra_deficit": f"0.25e0 * ({infra}) * (69e0 * {gate})",
        "vulnerability": f"0.25e0 * ({vuln}) * (69e0 * {gate})", "equity": EQUITY, "strategic": STRATEGIC,
        "urgency": URGENCY, "feasibility": feas, "cost_penalty": f"-({PENALTY})",
    }
    inner = ", ".join(f"{rnd(v, 2)} AS {k}" for k, v in parts.items())
    gap = f"0.25e0 * ({DEMAND}) + 0.25e0 * ({POPULATION}) + 0.25e0 * ({infra}) + 0.25e0 * ({vuln})"
    total = " + ".join(parts)
    return (
        f"SELECT *, {rnd(total, 2)} AS priority_score FROM (SELECT {keys}, {inner}, {rnd(gap, 4)} AS gap_score,"
        f" {rnd(gate, 4)} AS confidence_gate FROM {source}) nine"
    )


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one bit per letter of ``a``, letter by letter of ``b``."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    return (
        f"(length({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda ch: coalesce(list_sum("
        f"list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)),"
        f" lambda o, m: ((o + (o & m)) | (o - (o & m))) & {full})))"
    )


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100e0 WHEN length({a}) = 0 THEN 0e0 ELSE 200e0 * {_lcs(a, b)} / (length({a}) + length({b})) END)"


def _partial(a: str, b: str) -> str:
    """The best ratio of the shorter text with a window of its length over the longer one."""
    less = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)"
    more = f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    piece = f"substr({more}, greatest(k, 0) + 1, length({less}) + least(k, 0))"
    return (f"(CASE WHEN least(length({a}), length({b})) = 0 THEN 0e0 ELSE list_max(list_transform("
            f"range(1 - length({less}), length({more})), lambda k: {ratio(less, piece)})) END)")


def weighted(pairs: str) -> str:
    """A relation of (a, b, score) from one of distinct (a, b): the weighted ratio as published, for DuckDB."""
    joined = "array_to_string({x}, ' ')"
    return f"""(SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0e0
        WHEN span < 1.5 THEN greatest(plain, 0.95e0 * greatest({ratio('sa', 'sb')}, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0e0
             WHEN len(common) > 0 AND (len(oa) = 0 OR len(ob) = 0) THEN 100e0
             ELSE greatest({ratio('fa', 'fb')}, CASE WHEN shared = '' THEN 0e0 ELSE greatest({ratio('shared', 'fa')}, {ratio('shared', 'fb')}) END) END))
        ELSE greatest(plain, {_partial('a', 'b')} * scale, CASE WHEN len(common) > 0 THEN 100e0
             ELSE greatest({_partial('sa', 'sb')}, {_partial('da', 'db')}) END * 0.95e0 * scale) END AS score
      FROM (SELECT *, {ratio('a', 'b')} AS plain, CASE WHEN span <= 8 THEN 0.9e0 ELSE 0.6e0 END AS scale, {joined.format(x='list_sort(ta)')} AS sa,
             {joined.format(x='list_sort(tb)')} AS sb, {joined.format(x='oa')} AS da, {joined.format(x='ob')} AS db, {joined.format(x='common')} AS shared,
             trim({joined.format(x='common')} || ' ' || {joined.format(x='oa')}) AS fa, trim({joined.format(x='common')} || ' ' || {joined.format(x='ob')}) AS fb
        FROM (SELECT *, list_sort(list_distinct(list_intersect(ta, tb))) AS common, list_sort(list_distinct(list_filter(ta, lambda x: NOT list_contains(tb, x)))) AS oa,
               list_sort(list_distinct(list_filter(tb, lambda x: NOT list_contains(ta, x)))) AS ob
          FROM (SELECT a, b, greatest(length(a), length(b)) * 1e0 / greatest(least(length(a), length(b)), 1) AS span,
                 list_filter(string_split(a, ' '), lambda x: x <> '') AS ta, list_filter(string_split(b, ' '), lambda x: x <> '') AS tb FROM {pairs}) w1) w2) w3)"""
