"""The entry point: names, SQL for known queries only, the flagship query, and its independence of the corpus part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_and_sql():
    names = entry.queries().keys()
    assert entry.oracle_sql().keys() <= names and len(names) > 100


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "atp_status" in rows.columns


def test_imports_without_the_corpus_part(tmp_path):
    (tmp_path / "millrace").mkdir()
    for part in ("__spark_entry__.py", *(f"millrace/{x.name}" for x in (ROOT / "millrace").iterdir() if x.name != "llm")):
        (tmp_path / part).symlink_to(ROOT / part)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op') for x in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr


def test_imports_without_what_the_corpus_part_needs():
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op') for x in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr
