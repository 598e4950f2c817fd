import json

import pytest

from profilerank.plans.scoring import scored
from profilerank.rules import Rules
from profilerank.schema import profile_schema
from profilerank.session import local_session
from profilerank.sources import normalise


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def job(**kw):
    base = dict(title="Software Engineer", description="Built a ranking system in python.",
                start_date="2024-01-01", is_current=True, company="Acme", industry="", company_size="",
                duration_months=29)
    return {**base, **kw}


def profile(key, jobs=None, skills=(), head=None, signals=None, **kw):
    """A plain profile that passes every gate unless told otherwise."""
    return {
        "candidate_id": key,
        "profile": {"country": "India", "location": "Pune", "current_title": "Software Engineer",
                    "years_of_experience": 5.0, **(head or {})},
        "career_history": [job()] if jobs is None else list(jobs),
        "skills": list(skills),
        "signals": {"open_to_work_flag": True, "last_active_date": "2026-06-01", **(signals or {})},
        **kw,
    }


@pytest.fixture(scope="session")
def frame(spark):
    """Profiles as a DataFrame in the input schema; absent keys stay absent."""
    def make(profiles, partitions=2):
        lines = [(json.dumps(p),) for p in profiles]
        text = spark.createDataFrame(lines, "value string").repartition(partitions)
        from pyspark.sql import functions as F
        return text.select(F.from_json("value", profile_schema()).alias("p")).select("p.*")
    return make


@pytest.fixture(scope="session")
def score(frame):
    """Score profiles and give back the full rows by id."""
    def run(profiles, rules=None):
        rows = scored(normalise(frame(profiles)), rules or Rules()).collect()
        return {row.candidate_id: row for row in rows}
    return run
