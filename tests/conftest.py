import pytest

from lexicue.session import build
from lexicue.streaming.streams import ROCKSDB

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build(
        "local[8]", "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        },
    )
    yield s
    s.stop()
