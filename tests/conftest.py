import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("FATAL")
    yield session


@pytest.fixture(scope="session")
def dirty(spark):
    """Five dirty products with known clean values."""
    rows = [
        ("K10", "Garden", "$8.25", "64", 4.0, 12.0, "North Tools", 6.0),
        ("K11", "Toys", "$40.00", "-2", 3.0, 9.0, "Bright Play", 4.0),
        ("K12", "Books", "$12.50", "16", 2.5, 10.0, "Page Works", 8.0),
        ("K13", "Garden", "$150.00", "30", 1.0, 5.0, "North Tools", 10.0),
        ("K14", "Paint", "$22.00", "0", 6.0, 18.0, "Hue Works", 2.0),
    ]
    from shelfcast.sources.files import RAW_SCHEMA

    return spark.createDataFrame(rows, RAW_SCHEMA)
