"""The checkpoint folder: read from the session, one of our own only where it names none."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
from examlytics.session import ensure_checkpoint_dir, local_session
spark = local_session(1)
first = ensure_checkpoint_dir(spark)
assert first and first == ensure_checkpoint_dir(spark)
spark.range(3).checkpoint().count()
print("FOLDER", first)
"""


def run(tmp_path, **conf):
    home = tmp_path / "conf"
    home.mkdir()
    (home / "spark-defaults.conf").write_text("".join(f"{k.replace('_', '.')} {v}\n" for k, v in conf.items()))
    env = os.environ | {"SPARK_CONF_DIR": str(home), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split("FOLDER ")[1].strip()


def test_without_a_default_a_local_master_gets_a_folder(tmp_path):
    assert "examlytics-ckpt-" in run(tmp_path)


def test_the_folder_that_the_session_names_is_kept(tmp_path):
    assert run(tmp_path, spark_checkpoint_dir=f"{tmp_path}/shared").startswith(f"{tmp_path}/shared")
