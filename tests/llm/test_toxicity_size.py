"""The size of the toxicity model."""

import inspect

from leafmill.llm import linear, toxicity


def test_features_and_steps_are_whole():
    assert inspect.signature(toxicity.train).parameters["features"].default >= 4096
    assert inspect.signature(linear.Logistic.fit).parameters["steps"].default >= 300
