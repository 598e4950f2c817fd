"""Numbers that steer the scores.  Each can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from profilerank.vocabulary import Vocabulary

# Fixed values
TECHNICAL_WEIGHTS = {
    "relevance_ownership": 20,
    "production_ml": 15,
    "evaluation_rigor": 10,
    "product_ownership": 10,
    "retrieval_architecture": 7,
    "career_environment": 5,
    "production_scale": 2,
    "search_infra": 1,
}
CULTURE_WEIGHTS = {
    "founding_team_fit": 10,
    "python_depth": 5,
    "distributed_systems": 3,
    "external_validation": 2,
}
HIRE_WEIGHTS = {
    "availability_timeline": 6,
    "pipeline_friction": 4,
}
# (below this relevance index, the raw score may not exceed)
CEILINGS = ((40, 50), (60, 70), (80, 90))
TOP_CEILING = 100
EXPECTED_BY_LEVEL = {"beginner": 40, "intermediate": 65, "advanced": 80, "expert": 90}
# Points that each group of weights adds up to, whatever the single weights are
GROUP_POINTS = {"technical_fit": 70, "engineering_culture": 20, "hireability": 10}
# The two ways to show core relevance: shares of scores
RELEVANCE_MIX = (
    {"relevance_ownership": 0.50, "evaluation_rigor": 0.30, "retrieval_architecture": 0.20},
    {"relevance_ownership": 0.55, "recommendation_ownership": 0.45},
)
CALIBRATION = {
    "title_chaser": 0.90,
    "service_only": 0.85,
    "genai_wrapper": 0.90,
    "research_only": 0.80,
    "short_tenure": 0.95,
}
# (environment score from, factor)
ENVIRONMENT_FACTORS = ((95, 1.05), (80, 1.03))
ANOMALY_WEIGHTS = {
    "impossible_jobs": 0.3,
    "idle_experts": 0.4,
    "inverted_salary": 0.15,
    "active_before_signup": 0.25,
    "stuffed_skills": 0.2,
}
DEFAULT_LEVEL = "intermediate"
DEFAULT_EXPECTED = 65


@dataclass(frozen=True)
class Rules:
    today: date = date(2026, 6, 15)
    terms: Vocabulary = field(default_factory=Vocabulary)
    technical_weights: dict = field(default_factory=lambda: dict(TECHNICAL_WEIGHTS))
    culture_weights: dict = field(default_factory=lambda: dict(CULTURE_WEIGHTS))
    hire_weights: dict = field(default_factory=lambda: dict(HIRE_WEIGHTS))
    ceilings: tuple = CEILINGS
    top_ceiling: float = TOP_CEILING
    expected_by_level: dict = field(default_factory=lambda: dict(EXPECTED_BY_LEVEL))
    group_points: dict = field(default_factory=lambda: dict(GROUP_POINTS))
    relevance_mix: tuple = RELEVANCE_MIX
    calibration: dict = field(default_factory=lambda: dict(CALIBRATION))
    environment_factors: tuple = ENVIRONMENT_FACTORS
    anomaly_weights: dict = field(default_factory=lambda: dict(ANOMALY_WEIGHTS))
    weak_below: float = 25  # relevance index under which a record goes to the alternate track
    clear_from: float = 35  # and from which it passes; between them it needs a rescue
    rescue_above: float = 40  # relevance score that a rescue needs
    recent_code_months: int = 18
    short_tenure_months: int = 18
    early_ml_until: str = "2023-01-01"
    alternate_cap: float = 30.0

    @property
    def weights(self) -> dict:
        return {
            "technical_fit": self.technical_weights,
            "engineering_culture": self.culture_weights,
            "hireability": self.hire_weights,
        }
