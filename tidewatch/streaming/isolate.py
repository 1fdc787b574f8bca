"""A micro-batch goes on without the rows that make it fail.

If the work on a micro-batch raises, the rows are halved by a hash and both halves are tried on their own, until the failing rows stand
alone. Those go to the dead letters with their error; what the others give is kept. For b bad rows among n it takes about
2 * b * log2(n) attempts, and a single one if there are none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import remove, scratch_dir, stored_as

MOST = 100  # different rows that may fail in a micro-batch before the fault is taken to lie elsewhere


class TooManyFailures(RuntimeError):
    """More rows fail than single ones would explain: a store is down, or the work itself is wrong."""


def _said(error: Exception) -> str:
    """The line of an error that says what happened; Spark reports a task's error below its own."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    told = [line for line in lines if line.split(":")[0].endswith(("Error", "Exception"))]
    return (told[-1] if told else lines[0] if lines else type(error).__name__)[:1000]


def isolating(work: Callable[[DataFrame], DataFrame], path: str, dead: str, most: int = MOST) -> Callable[[DataFrame, int], None]:
    """A sink that writes ``work(rows)`` of every micro-batch below ``path`` and the rows that make it raise below ``dead``.

    ``work`` must give the same for a row whatever rows are beside it. Dead letters are the whole rows, as struct ``row``, with their
    ``error``; equal rows fail together. If more than ``most`` different rows fail, TooManyFailures is raised and the micro-batch
    is tried again as a whole, as it is when the work does not fit the columns. A replay overwrites its own output.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = scratch_dir(spark, "isolating")
        rows = stored_as(batch.select(F.struct("*").alias("row"), F.xxhash64(F.to_json(F.struct("*"))).alias("place")), f"{own}/rows")
        done, failed, waiting, tried = [], [], [(-(2**63), 2**63 - 1)], 0
        while waiting:
            low, high = waiting.pop()
            part = rows.where(F.col("place").between(low, high))
            target = f"{own}/out-{tried}" if tried else f"{path}/batch={batch_id}"
            tried += 1
            try:
                result = work(part.select("row.*"))
                result.write.mode("overwrite").parquet(target)
                done.append((target, result.schema))
                continue
            except AnalysisException:
                raise
            except Exception as error:  # whatever the work raises on a row is that row's error
                said = _said(error)
            least, last = part.agg(F.min("place"), F.max("place")).first()
            if least is None or len(failed) >= most:
                for folder in (own, f"{path}/batch={batch_id}"):
                    remove(spark, folder)
                raise TooManyFailures(f"{len(failed)} rows of micro-batch {batch_id} fail, and more with: {said}")
            if least == last:
                failed.append(part.select("row", F.lit(said).alias("error")))
            else:
                middle = (least + last) // 2  # both halves have rows
                waiting += [(least, middle), (middle + 1, last)]
        if failed:
            parts = [spark.read.schema(schema).parquet(target) for target, schema in done]
            if parts:
                reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            else:
                remove(spark, f"{path}/batch={batch_id}")
            reduce(DataFrame.unionByName, failed).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        else:
            remove(spark, f"{dead}/batch={batch_id}")  # of an earlier attempt
        remove(spark, own)
    return run
