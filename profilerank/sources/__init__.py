"""Reading profiles and writing results."""

from profilerank.sources.profiles import (
    accepted, keep_last, normalise, observed, read_profiles, reject_report, stream_profiles,
)
from profilerank.sources.sinks import read_scores, write_ranked, write_scores

__all__ = [
    "accepted", "keep_last", "normalise", "observed", "read_profiles", "read_scores",
    "reject_report", "stream_profiles", "write_ranked", "write_scores",
]
