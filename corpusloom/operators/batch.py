"""Batch generation with a function the user supplies."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.schemas import RESPONSES


#: Requests whose replies are handed on together.
CHUNK = 64
#: File in a store of replies that ends the runs that fill it; Spark's readers skip it.
STOP = "_STOP"
#: Seconds between two looks for it.
STOP_POLL = 1.0


class Cancelled(Exception):
    """Raised by a generate function when the request must not be tried again."""


def _call(call, request: dict, timeout: float | None):
    """The reply, or TimeoutError once ``timeout`` seconds are over.

    A call that hangs is left behind in a daemon thread, since Python can't end it.
    """
    if timeout is None:
        return call(request)
    out: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            out.put((call(request), None))
        except BaseException as failure:  # handed to the waiting thread
            out.put((None, failure))

    threading.Thread(target=work, daemon=True).start()
    try:
        response, failure = out.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"no reply within {timeout:g} s") from None
    if failure is not None:
        raise failure
    return response


def _generate(
    call, request: dict, tries: int, waits: Sequence[float], timeout: float | None, deadline: float | None, only_timeouts: bool,
) -> tuple:
    end = None if deadline is None else time.monotonic() + deadline
    error = None
    for attempt in range(1, tries + 1):
        if attempt > 1 and waits:
            time.sleep(waits[min(attempt - 2, len(waits) - 1)])
        left = None if end is None else end - time.monotonic()
        if left is not None and left <= 0:
            return None, f"deadline exceeded after {attempt - 1} attempts: {error}", attempt - 1
        try:
            response = _call(call, request, min((t for t in (timeout, left) if t is not None), default=None))
        except Cancelled as stop:
            return None, f"cancelled: {stop}", attempt
        except Exception as failure:  # one bad request must not fail the job
            error = f"{type(failure).__name__}: {failure}"
            if only_timeouts and not isinstance(failure, TimeoutError):
                return None, f"failed after {attempt} attempts: {error}", attempt
            continue
        if response is None:
            return None, "no choices", attempt
        return response, None, attempt
    return None, f"failed after {tries} attempts: {error}", tries


def generate(
    requests: DataFrame, call: Callable[[dict], str | None], tries: int = C.GENERATE_TRIES,
    waits: Sequence[float] = C.GENERATE_WAITS, parallelism: int | None = None,
    timeout: float | None = C.GENERATE_TIMEOUT, deadline: float | None = None, only_timeouts: bool = False,
    calls: int = 1,
) -> DataFrame:
    """(request_id, response, error, attempts), one row per request.

    ``call`` gets a request as a dict and returns the reply, or None for no choices. It
    runs on the executors, ``calls`` at a time in a task (more than one only if it is safe
    in threads), and replies are handed on in small chunks. A try ends after ``timeout`` seconds and a request after ``deadline``
    seconds with all its tries (None: never). With ``only_timeouts`` other errors aren't
    tried again. Requests are spread evenly over ``parallelism`` tasks (by default those
    of the cluster) first, since a call costs far more than moving its row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(request: dict) -> tuple:
            return request["request_id"], *_generate(call, request, tries, waits, timeout, deadline, only_timeouts)

        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                for start in range(0, len(batch), CHUNK):
                    rows = list(pool.map(one, batch.iloc[start:start + CHUNK].to_dict("records")))
                    yield pd.DataFrame(rows, columns=[f.name for f in RESPONSES.fields])

    parallelism = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    return requests.repartition(parallelism, "request_id").mapInPandas(run, RESPONSES)


def _replies_written(store: str, prefix: str) -> set[int]:
    """Requests that an earlier attempt of a task has answered in this run."""
    system, root = files.FileSystem.from_uri(store)
    found = system.get_file_info(files.FileSelector(root, allow_not_found=True))
    names = [f.path for f in found if f.base_name.startswith(prefix)]
    return {i for name in names for i in pq.read_table(name, ["request_id"], filesystem=system)["request_id"].to_pylist()}


def generate_stored(
    requests: DataFrame, call: Callable[[dict], str | None], store: str, tries: int = C.GENERATE_TRIES,
    waits: Sequence[float] = C.GENERATE_WAITS, parallelism: int | None = None,
    timeout: float | None = C.GENERATE_TIMEOUT, deadline: float | None = None, only_timeouts: bool = False,
    calls: int = 1, chunk: int = CHUNK, again: bool = False,
) -> DataFrame:
    """``generate``, with replies kept in the folder ``store`` as they come; see there for the rest.

    Runs at once and returns the replies in the store. A run asks only for what the store
    lacks, and with ``again`` for what ended in an error there. Every task writes its
    replies in files of up to ``chunk``, which appear in one step; an attempt that follows
    a lost one reads what that one wrote, so a lost executor costs at most a chunk for
    each of its tasks. ``stop`` ends the run in all tasks: calls under way come to their
    end and are stored, and no other starts. ``store`` is a path or URI that driver and
    executors share.
    """
    spark = requests.sparkSession
    system, root = files.FileSystem.from_uri(store)
    system.create_dir(root)
    if system.get_file_info(f"{root}/{STOP}").type != files.FileType.NotFound:
        system.delete_file(f"{root}/{STOP}")
    done = stored_replies(spark, store)
    todo = requests.join((done.where("error IS NULL") if again else done).select("request_id"), "request_id", "left_anti")
    run_id = uuid.uuid4().hex
    columns = [f.name for f in RESPONSES.fields]
    schema = pa.schema([("request_id", pa.int64()), ("response", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = files.FileSystem.from_uri(store)
        context = TaskContext.get()
        prefix = f"run-{run_id}-{context.partitionId()}-"
        written = _replies_written(store, prefix) if context.attemptNumber() else set()
        seen, ended = -STOP_POLL, False

        def stopped() -> bool:
            nonlocal seen, ended
            if not ended and time.monotonic() - seen >= STOP_POLL:
                seen = time.monotonic()
                ended = system.get_file_info(f"{root}/{STOP}").type != files.FileType.NotFound
            return ended

        def one(request: dict) -> tuple | None:
            if request["request_id"] in written or stopped():
                return None
            return request["request_id"], *_generate(call, request, tries, waits, timeout, deadline, only_timeouts)

        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                for start in range(0, len(batch), chunk):
                    got = pool.map(one, batch.iloc[start:start + chunk].to_dict("records"))
                    rows = [row for row in got if row is not None]
                    if rows:
                        name = f"{prefix}{uuid.uuid4().hex}.parquet"
                        table = pa.Table.from_pylist([dict(zip(columns, row)) for row in rows], schema)
                        pq.write_table(table, f"{root}/_{name}", filesystem=system)
                        system.move(f"{root}/_{name}", f"{root}/{name}")
                    yield pd.DataFrame({"n": [len(rows)]})

    parallelism = parallelism or spark.sparkContext.defaultParallelism
    todo.repartition(parallelism, "request_id").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return stored_replies(spark, store)


def stop(store: str) -> None:
    """End the runs of ``generate_stored`` on this store, from any process; the next one goes on."""
    system, root = files.FileSystem.from_uri(store)
    system.open_output_stream(f"{root}/{STOP}").close()


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """(request_id, response, error, attempts) of a store, one row per request.

    A request may have two where a task ran twice at a time, or was asked again after an
    error: a reply goes before an error, else the first by file name.
    """
    replies = spark.read.schema(RESPONSES).parquet(store).withColumn("file", F.col("_metadata.file_name"))
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "file", "response", "error", "attempts")).alias("best")
    return replies.groupBy("request_id").agg(best).select("request_id", "best.response", "best.error", "best.attempts")


def map_files(
    files: DataFrame, callback: Callable[[str, str, str, str], str | None], schema: str = "result string"
) -> DataFrame:
    """(repo, path, result) of a Python callback per file (repo, path, lang, content)."""
    name = schema.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [callback(*row) for row in batch.itertuples(index=False, name=None)]
            yield batch[["repo", "path"]].assign(**{name: results})

    narrow = files.select("repo", "path", "lang", F.col("content").cast("string").alias("content"))
    return narrow.mapInPandas(run, f"repo string, path string, {schema}")
