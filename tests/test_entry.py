"""The entry goes on without what only the training-data operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tallybook.sources.sales import read_sales
from tests.conftest import SMALL

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("missing", ["tallybook.llm", "corpus_pipeline", "tiktoken", "tokenizers"])
def test_the_tables_queries_stay_when_a_library_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    tables, known = map(int, done.stdout.split())
    assert tables == known > 80


def test_a_longer_sheet_is_read_by_more_tasks(spark, monkeypatch):
    """The lines that one task of split_order reads do not grow with the sheet."""
    read = []

    def noted(session, path):
        read.append((spark.conf.get("spark.sql.files.maxPartitionNum"), len(list(Path(path).glob("*.csv")))))
        return read_sales(session, path)

    monkeypatch.setattr(entry, "read_sales", noted)
    [three] = entry.queries()["split_order"](spark, SMALL).collect()
    monkeypatch.setattr(entry, "_FILE_LINES", 100)
    [more] = entry.queries()["split_order"](spark, SMALL).collect()
    files = -(-more["rows"] // 100)
    assert read == [("3", 24), (str(files // 8), files)]
    assert more == three and more["rows"] == more["ids"] and more["misplaced"] == 0
