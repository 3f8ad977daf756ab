import pytest

from ledgerframe.functions.ids import ProjectionId, TypedId, snapshot_type, validate_type
from ledgerframe.plans.catalog import PROJECTIONS, SAMPLES


def test_round_trip():
    for kind in ("account", "a", "my_type", "a__b"):
        for new in (TypedId.new_v4, TypedId.new_v7):
            x = new(kind)
            assert TypedId.parse(str(x)) == x


@pytest.mark.parametrize("text", [*SAMPLES[6:], SAMPLES[0] + "\n"])
def test_rejected(text):
    with pytest.raises(ValueError):
        TypedId.parse(text)


@pytest.mark.parametrize("text", SAMPLES[:6])
def test_accepted(text):
    assert str(TypedId.parse(text)) == text


def test_v7_is_ordered_by_millisecond():

    a, b = TypedId.new_v7("t", 1_700_000_000_000), TypedId.new_v7("t", 1_700_000_000_001)
    assert a.uuid < b.uuid and a.uuid[14] == "7"


def test_types_and_projections():
    for bad in ("", "_", "_a", "a_"):
        with pytest.raises(ValueError):
            validate_type(bad)
    assert snapshot_type("account") == "accountsnapshot"
    good = [p for p in PROJECTIONS if _valid(*p)]
    assert good == [("orders", 1), ("a", 1), ("a_b9", 12), ("a" * 40, 1)]
    assert str(ProjectionId("orders", 3)) == "orders_v3"


def _valid(name, version):
    try:
        return bool(ProjectionId(name, version).validate())
    except ValueError:
        return False
