"""The entry works whole, and in a copy without the optional folders and files."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def said(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=True)
    n, pipeline, llm = done.stdout.split()
    return int(n), pipeline == "True", llm == "True"


@pytest.mark.parametrize("gone", [["lodewright/llm", "tests/llm", "corpus_pipeline.py"], ["lodewright/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_copy_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("lodewright", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, copy / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, copy / name)
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True)
    n, pipeline, llm = said(copy)
    assert n > 200 and not pipeline and llm == (copy / "lodewright/llm").exists()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 35


def test_scratch_tables_go(spark):
    from lodewright import storage

    with storage.scratch(spark) as kept:
        one = storage.materialize(spark.range(5), "one")
        two = kept(storage.materialize(one.filter("id > 2"), "two"))
    assert two.count() == 2 and 0 < storage.bytes_of(two) < 10_000
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        spark.read.schema("id long").parquet(one.inputFiles()[0]).collect()
