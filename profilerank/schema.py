"""Input schema.  Given up front, so that reading never needs an inference pass."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

HEADER = _struct(summary=_S, headline=_S, current_title=_S, country=_S, location=_S,
                 years_of_experience=_D)
JOB = _struct(title=_S, description=_S, company=_S, industry=_S, company_size=_S,
              start_date=_S, end_date=_S, duration_months=_I, is_current=_B)
SKILL = _struct(name=_S, proficiency=_S, duration_months=_I, endorsements=_I)
CERTIFICATION = _struct(name=_S)
SIGNALS = _struct(
    skill_assessment_scores=T.MapType(_S, _D),
    willing_to_relocate=_B, open_to_work_flag=_B,
    last_active_date=_S, signup_date=_S, notice_period_days=_I,
    recruiter_response_rate=_D, interview_completion_rate=_D, github_activity_score=_D,
    verified_email=_B, verified_phone=_B,
    expected_salary_range_inr_lpa=_struct(min=_D, max=_D),
)


def profile_schema(signals_field: str = "signals") -> T.StructType:
    """Schema of a profile record; the name of the signals object differs by source."""
    return T.StructType([
        T.StructField("candidate_id", _S),
        T.StructField("profile", HEADER),
        T.StructField("career_history", T.ArrayType(JOB)),
        T.StructField("skills", T.ArrayType(SKILL)),
        T.StructField("certifications", T.ArrayType(CERTIFICATION)),
        T.StructField(signals_field, SIGNALS),
    ])
