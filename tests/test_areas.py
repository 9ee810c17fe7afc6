import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from countylens.functions import areas, measures


def test_fips_and_back(one):
    assert one(areas.fips(F.lit(1), F.lit(1))) == 1001
    assert one(areas.fips(F.lit(42), F.lit(3))) == 42003
    assert one(areas.state_of(F.lit(42003))) == 42
    assert one(areas.is_county(F.lit(42003))) and not one(areas.is_county(F.lit(42000)))


def test_state_range(one):
    inside = [c for c in (41999, 42000, 42003, 42999, 43000)
              if one(areas.is_in_state(F.lit(c), 42))]
    assert inside == [42000, 42003, 42999]


def test_checked_code_fails_outside(one):
    assert one(areas.checked_code(F.lit(99999))) == 99999
    with pytest.raises(Exception, match="is not an area code"):
        one(areas.checked_code(F.lit(100000)))


@pytest.mark.parametrize("name", ["prince george's", "ST. X-Y", "2nd", "doña ana", "", "o'neil 3rd-b"])
def test_title_case_like_python(one, name):
    assert one(areas.title_case(F.lit(name))) == name.title()


@pytest.mark.parametrize("x,up,want", [(11.0, True, 20), (11.0, False, 10), (-3.0, True, 0),
                                       (-3.0, False, -10), (20.0, True, 20), (0.0, False, 0)])
def test_round_to(one, x, up, want):
    assert one(areas.round_to(F.lit(x), 10, up)) == want


def test_dates_and_numbers_from_dirty_text(one):
    assert one(areas.parse_date(F.lit(" 2020-11-29 "))) == date(2020, 11, 29)
    assert one(areas.parse_date(F.lit("2020-11-29 00:00:00"))) == date(2020, 11, 29)
    assert one(areas.parse_date(F.lit("soon"))) is None
    assert one(areas.parse_long(F.lit(" 12 "))) == 12
    assert one(areas.parse_long(F.lit("x"))) is None
    assert one(areas.number_or_null(F.lit(math.nan))) is None


def test_valid_value(one):
    values = [(-1.0, False), (0.0, True), (3.5, True), (math.nan, False)]
    assert [one(areas.is_valid_value(F.lit(v))) for v, _ in values] == [ok for _, ok in values]
    assert not one(areas.is_valid_value(F.lit(None).cast("double")))


def test_labels(one):
    assert one(areas.as_of_label(F.lit(date(2020, 11, 9)))) == "November 09, 2020"
    title = measures.correlation_title("a", "b", F.lit(-0.14914))
    assert one(title) == "Correlation between a and b: -0.1491"
    assert one(measures.correlation_title("a", "b", F.lit(None).cast("double"))).endswith(": nan")
