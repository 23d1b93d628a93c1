import pytest

from careerloom.plans.demo import Careers
from careerloom.plans.queries import QUERIES
from careerloom.streaming import feeds


class Started(Exception):
    pass


def test_rebuild_starts_from_stored_records(spark, monkeypatch):
    """Both batches read them: lines that are not stored would be joined anew by every frame made of them."""
    kept = set()

    def store(self, *names):
        kept.update(names)
        return self

    def start(*args, **options):
        raise Started

    monkeypatch.setattr(Careers, "store", store)
    monkeypatch.setattr(feeds, "stream_rebuild", start)
    with pytest.raises(Started):
        QUERIES["stream_rebuild"](spark, "/root/testdata/sf0.001")
    assert {"persons", "line", "raw_person", "raw_refs", "merged_person"} <= kept
