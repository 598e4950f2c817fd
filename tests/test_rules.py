"""Rules given as data change the scores as they say."""

from dataclasses import replace

from profilerank.rules import Rules
from tests.conftest import profile


def test_replaced_weights_keep_the_points_of_their_group(score):
    plain = score([profile("a")])["a"]
    doubled = Rules(technical_weights={k: 2 * w for k, w in Rules().technical_weights.items()})
    assert abs(score([profile("a")], doubled)["a"].technical_fit - plain.technical_fit) < 0.11


def test_replaced_factors(score):
    chaser = profile("a", signals={"expected_salary_range_inr_lpa": {"min": 9.0, "max": 5.0}})
    heavy = replace(Rules(), anomaly_weights={**Rules().anomaly_weights, "inverted_salary": 0.5})
    assert round(score([chaser])["a"].anomaly_factor, 6) == 0.85
    assert round(score([chaser], heavy)["a"].anomaly_factor, 6) == 0.5
    strict = replace(Rules(), clear_from=101, weak_below=101)
    assert score([profile("a")], strict)["a"].route != score([profile("a")])["a"].route or \
        score([profile("a")])["a"].gate != "clear"
