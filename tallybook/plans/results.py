"""Results of SQL text that are kept until the tables change.

A result is stored under the SQL text, its parameters and the number of the log entry
that the tables were read at. The same question then reads the stored rows and none
of the tables; after the next load the number is another one, and the question is
answered anew. A stored result counts once its entry in the index exists, which is
written last and once, so a result that failed half-way is never read, and of two
that are made at the same time one counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallybook.plans.views import register_views, run_query
from tallybook.sources.log import State, create_once, read_state
from tallybook.sources.tables import read_tables


def _question(sql: str, params: dict | None) -> str:
    named = sorted((name, type(value).__name__, str(value)) for name, value in (params or {}).items())
    return hashlib.sha256(json.dumps([sql, named]).encode()).hexdigest()


def _stored(spark: SparkSession, place: str, question: str) -> DataFrame | None:
    try:
        entry = spark.read.schema("rows string").json(f"{place}/index/{question}.json").first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return spark.read.parquet(f"{place}/{entry['rows']}")


def results_place(folder: str, state: State) -> str:
    """Where the results of one state of the tables are; those of earlier ones can be deleted."""
    return f"{folder}/results/{state.seq:012}"


def kept_query(spark: SparkSession, folder: str, sql: str, params: dict | None = None) -> DataFrame:
    """Run SQL text over the tables and views of a folder, or give its result as it was kept.

    The text names the tables and the five views; parameters are written :name. Its
    result must not depend on the time it is run at. Runs a job if the result is new.
    """
    state = read_state(spark, folder)
    place, question = results_place(folder, state), _question(sql, params)
    found = _stored(spark, place, question)
    if found is None:
        register_views(read_tables(spark, folder, state))
        rows = f"rows-{uuid.uuid4().hex}"
        run_query(spark, sql, params).write.parquet(f"{place}/{rows}")
        create_once(spark, f"{place}/index", f"{question}.json", json.dumps({"rows": rows}))
        found = _stored(spark, place, question)
    return found
