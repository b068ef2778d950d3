"""tools/scale_study.py runs end to end and both plans agree."""

import os
import subprocess
import sys

from tests.conftest import REPO, SF_SMOKE


def test_scale_study_runs(tmp_path):
    proc = subprocess.run(
        [
            sys.executable,
            os.path.join(REPO, "tools", "scale_study.py"),
            str(tmp_path / "study"),
            "--sf-dir",
            SF_SMOKE,
            "--copies",
            "2",
            "--runs",
            "1",
            "--cpus",
            "2",
            "--shuffle-partitions",
            "4",
        ],
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert proc.returncode == 0, proc.stderr[-3000:]
    verdicts = [line for line in proc.stdout.splitlines() if "same result" in line]
    assert len(verdicts) == 3
    assert all(line.endswith("same result: True") for line in verdicts)
