import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabprobe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="tabprobe-tests")
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tabprobe-test-")


@pytest.fixture()
def boats_df(spark):
    """Harbour entries: a text key, two numbers (one with a gap), a class."""
    rows = [("Kestrel", 9, 410.5, "sloop"), ("Marigold", 14, None, "ketch"), ("Osprey", 21, 980.0, "sloop"),
            ("Petrel", 11, 455.0, "yawl"), ("Quail", 17, 720.25, "ketch"), ("Tern", 12, 505.0, "sloop")]
    return spark.createDataFrame(rows, "boat string, length bigint, sail double, rig string")


@pytest.fixture()
def boats_csv(tmpdir_path):
    path = os.path.join(tmpdir_path, "boats.csv")
    lines = ["Boat,Length,Sail Area,Rig,Launched", "Kestrel,9,410.5,sloop,1998-04-02", "Marigold,14,,ketch,2003-09-30",
             "Osprey,21,980.0,sloop,1987-06-14", "Petrel,,455.0,yawl,2011-01-09", "Quail,17,720.25,ketch,1979-12-24",
             "Tern,12,505.0,sloop,2015-08-08", "Tern,12,505.0,sloop,2015-08-08"]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path
