"""Queries with Python workers run from an empty folder, without the repository on the workers' path."""
import os
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import SMALL

REPO = str(Path(__file__).resolve().parents[1])
CODE = """
import sys
sys.path.insert(0, {repo!r})
from bourselake.session import build_session
from bourselake.plans import registry
spark = build_session("away", "local[4]", **{{"spark.sql.shuffle.partitions": "4"}})
print("ROWS", registry.queries()[{name!r}](spark, {data!r}).count())
"""


@pytest.mark.parametrize("name", ["pair_self_join", "shared_member_link", "market_regime"])
def test_runs_away_from_the_repository(name, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=REPO, name=name, data=SMALL)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
