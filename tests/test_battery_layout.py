"""The battery of analyses works where careers lie by session."""

import pytest
from pyspark.sql import functions as F

from careerloom.operators import analyze
from careerloom.plans import insights
from careerloom.plans.demo import Careers
from conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def careers(spark):
    return Careers(spark, SF).store("persons", "line", "job", "skill", "tech", "matches")


@pytest.mark.parametrize("kind", ["skill_gap", "career_topology", "tech_evolution", "esco_coverage", "role_progression"])
def test_lines_are_made_without_an_exchange(careers, kind):
    df = insights.ANALYZERS[kind](careers.career_frames())
    df.write.format("noop").mode("overwrite").save()
    assert "Exchange hashpartitioning" not in str(df._jdf.queryExecution().executedPlan())


def test_lines_by_session_give_the_same_documents(careers):
    got, failed = insights.run_battery(careers.career_frames(), F.lit("2001-01-01"), buckets=careers.buckets)
    plain, also = insights.run_battery(careers.career_frames(), F.lit("2001-01-01"))
    assert not failed and not also
    columns = ["session_id", "analysis_type", "content", "entity_count"]
    assert rows(got, *columns) == rows(plain, *columns) and got.count() == 6 * careers.persons.count()


def test_claims_are_the_claimed_part_of_the_gap(careers):
    gap = analyze.skill_gap(careers.skill, careers.tech).filter("status <> 'used_only'")
    columns = ["session_id", "key", "label", "status", "category", "proficiency_level"]
    assert rows(analyze.claimed_skills(careers.skill, careers.tech), *columns) == rows(gap, *columns)
