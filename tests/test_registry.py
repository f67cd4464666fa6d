import pytest

import __spark_entry__ as contract
from logweir.plans.queries import QUERIES
from compare import difference, duck
from conftest import SF_DIR

# The thinnest table lacks events that match; these are checked at the next size.
SPARSE = {
    "alert_cooldown", "alert_records", "error_rate_alerts", "notification_payload",
    "decode_alerts", "recurring_errors", "search_hot", "search_merged", "stream_notifications", "stream_recurring",
    "stream_anchored_alerts", "stream_error_alerts",
}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def databases():
    return {folder: duck(folder) for folder in (SF_DIR, LARGER)}


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, databases, name):
    folder = LARGER if name in SPARSE else SF_DIR
    got = contract.queries()[name](spark, folder)
    assert difference(got, databases[folder], contract.oracle_sql()[name]) is None
