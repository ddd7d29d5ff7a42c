import pytest

from augury.catalog import oracle_sql, queries
from augury.catalog import scoring
from augury.operators import resample


@pytest.mark.parametrize("name, wanted", [("week_bootstrap", 2000), ("iso_week_bootstrap", 10000), ("arm_compare", 10000)])
def test_registered_replicates_are_those_of_the_reference(spark, monkeypatch, name, wanted):
    seen, real = [], resample.bootstrap
    monkeypatch.setattr(scoring.resample, "bootstrap", lambda b, by, t, reps, seed: seen.append(reps) or real(b, by, t, reps, seed))
    queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [wanted] and f"range({wanted})" in oracle_sql()[name]


def test_quality_interval_has_the_resamples_of_the_reference(spark, monkeypatch):
    from augury.catalog import models
    seen = []
    monkeypatch.setattr(models.models, "quality_interval", lambda *given: seen.append(given[6]))
    queries()["quality_interval"](spark, "/root/testdata/sf0.001")
    assert seen == [100]
