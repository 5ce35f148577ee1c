"""Import of chunk tables from SQLite files."""

from __future__ import annotations

import sqlite3

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DDL = "path string, chunk_id string, text string, start_line int, end_line int, mtime_ns long, model string, vector array<float>"


def read_chunks(spark: SparkSession, files: list[str], model: str, dim: int) -> DataFrame:
    """Rows of `chunks` of one model whose embedding (little-endian float32) has `dim` components.

    One task a file; files must be readable where tasks run. chunk_id is path:start-end.
    """

    def run(batches):
        for b in batches:
            for name in b["file"]:
                with sqlite3.connect(f"file:{name}?mode=ro", uri=True) as db:
                    cursor = db.execute("select path, mtime_ns, start_line, end_line, text, embedding from chunks where model = ?", (model,))
                    while rows := cursor.fetchmany(4096):
                        kept = [r for r in rows if r[5] is not None and len(r[5]) == 4 * dim]
                        yield pd.DataFrame(
                            [(p, f"{p}:{s}-{e}", t, s, e, m, model, np.frombuffer(v, dtype="<f4")) for p, m, s, e, t, v in kept],
                            columns=[c.split()[0] for c in DDL.split(", ")],
                        )

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInPandas(run, DDL)
