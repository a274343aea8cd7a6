import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from caselens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("8", partitions=4, app="caselens-tests")
    s.sparkContext.setLogLevel("ERROR")
    # tiny inputs: interpreting is faster than compiling each plan
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
