import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgermatch.session import local_session

    s = local_session("*", shuffle_partitions=8, app="ledgermatch-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cfg():
    from ledgermatch.sources import fixture_config

    return fixture_config()


@pytest.fixture(scope="session")
def sources(spark, cfg):
    """sf0.001 inputs, derived once and written to parquet for the session."""
    import tempfile

    from ledgermatch.sources import derive_sources, read_sources

    src = derive_sources(spark, SF0001, cfg)
    d = tempfile.mkdtemp(prefix="ledgermatch-test-", dir="/tmp")
    paths = {}
    for name in ("invoices", "invoice_headers", "invoice_lines", "transactions"):
        paths[name] = os.path.join(d, name)
        getattr(src, name).coalesce(2).write.parquet(paths[name])
    return read_sources(spark, paths, cfg=cfg)
