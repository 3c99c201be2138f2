import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return session


@pytest.fixture
def usage_of(spark):
    """Usage rows from dicts; fields not given get plain defaults."""
    from tallyforge.schema import SOURCE_RELATIONAL, USAGE

    defaults = {
        "source": SOURCE_RELATIONAL, "ts_ms": 0, "model": "m", "input_tokens": 0, "output_tokens": 0,
        "reasoning_in_output": False, "duration_derived": False, "source_file": "f",
    }

    def build(*rows):
        full = [{**defaults, "line_no": i, "event_key": str(i), **row} for i, row in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(f.name) for f in USAGE.fields) for r in full], USAGE)

    return build


@pytest.fixture
def log_dir(tmp_path):
    """Writes log files below a folder whose name is no skipped directory."""
    import json

    def write(files):
        root = tmp_path / "logs"
        for name, lines in files.items():
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            text = "".join((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines)
            path.write_text(text)
        return str(root)

    return write
