"""Queries that once picked ids run over whole tables."""

import pytest
from oracle import SF

from tidepool.plans import flows, registry, relational  # noqa: F401
from tidepool.sources.domain import Domain


@pytest.mark.parametrize(
    "name, rows",
    [
        ("join_item_to_parent_key", lambda d: d.items().join(d.sections(), "section_id").count()),
        ("filter_claim_verified", lambda d: d.claims().where("status = 'verified'").count()),
        ("life_get", lambda d: d.claims().join(d.campaigns(), "venue_id").count()),
        ("life_clone_alert_whole", lambda d: d.alerts().where("active").count()),
    ],
)
def test_whole_table(spark, name, rows):
    assert registry.QUERIES[name](spark, SF).count() == rows(Domain(spark, SF))
