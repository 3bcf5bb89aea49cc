"""Where stored tables may go."""

import pytest

from kinmatch.session import is_shared


@pytest.mark.parametrize(
    "folder, master, shared",
    [
        ("file:/tmp/warehouse", "local[8]", True),
        ("file:/tmp/warehouse", "local", True),
        ("file:/tmp/warehouse", "local-cluster[3,2,1024]", False),
        ("file:///tmp/warehouse", "spark://host:7077", False),
        ("/tmp/warehouse", "yarn", False),
        ("hdfs://name/warehouse", "yarn", True),
        ("s3a://bucket/warehouse", "k8s://https://host", True),
    ],
)
def test_local_warehouses_are_for_one_machine(folder, master, shared):
    assert is_shared(folder, master) is shared
