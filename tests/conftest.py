from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cargoscope.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", shuffle_partitions=8)
    # Tests set their own checkpoint folder only where the environment names none.
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="cargoscope-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def out_dir():
    return tempfile.mkdtemp(prefix="cargoscope-test-out-", dir="/tmp")
