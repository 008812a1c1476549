import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
FIXTURES = Path(__file__).parent / "fixtures"


@pytest.fixture(scope="session")
def spark():
    from fleet_audit.session import local_session

    session = local_session(memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    from fleet_audit.sources.backup import read_config_backup

    return read_config_backup(spark, str(FIXTURES)).persist()


@pytest.fixture(scope="session")
def entries(files):
    from fleet_audit.operators.normalize import normalize_values
    from fleet_audit.sources.parsers import parse_all

    return normalize_values(parse_all(files)).persist()


@pytest.fixture(scope="session")
def rules(spark):
    from fleet_audit.sources.catalog import read_rules

    return read_rules(spark, str(FIXTURES / "rules"))


@pytest.fixture(scope="session")
def context(spark):
    from fleet_audit.sources.context import read_context

    return read_context(spark, str(FIXTURES / "context"))
