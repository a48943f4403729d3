"""Seams to what is not relational: decoders, web services and judges.

Each takes a table and gives a table.  What runs behind a seam is passed in, so
tests and offline runs put a replay there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue
from threading import Thread

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import LAYOUT_ITEMS, RAW_BLOCKS
from .case_sink import located

#: One decoded page block: page, type, x0, y0, x1, y1, text, size.
Decoder = Callable[[bytes], list[tuple]]
#: Prompt in, answer out; raises RuntimeError or ValueError where the call fails.
Judge = Callable[[str], str]
JUDGE_TIMEOUT_S, HTTP_TIMEOUT_S, JUDGE_TRIES = 600, 25, 2


class _Caller:
    """A thread that makes one call after the other until it is told to end."""

    def __init__(self) -> None:
        self.calls, self.answers = SimpleQueue(), SimpleQueue()
        self.thread = Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while (asked := self.calls.get()) is not None:
            call, argument = asked
            try:
                answer = (call(argument), None)
            except Exception as e:  # noqa: BLE001  any client's error is an answer
                answer = (None, e)
            except BaseException as e:  # noqa: BLE001  what would end the thread is none
                answer = (None, TimeoutError(f"the call was ended by {type(e).__name__}"))
            self.answers.put(answer)
            del asked, call, argument, answer


#: Calls that have run out of time and not ended, in this worker, and the thread that the next call goes to.
MOST_HUNG = 32
_hung: list[Thread] = []
_idle: list[_Caller] = []


def within(call: Callable, argument, seconds: float):
    """What a call gives, or its error; TimeoutError where it takes longer, as a client may not keep to a limit of its own.

    The calls of a worker run on one thread, until one is late: nothing waits
    for that thread then, and the next call gets another.  A worker has
    MOST_HUNG such threads at most: while so many calls still hang, a further
    one isn't begun and counts as late.
    """
    if _hung:
        _hung[:] = [t for t in _hung if t.is_alive()]
        if len(_hung) >= MOST_HUNG:
            raise TimeoutError(f"{len(_hung)} calls of this worker hang")
    caller = _idle.pop() if _idle else None
    if caller is None or not caller.thread.is_alive():
        caller = _Caller()
    caller.calls.put((call, argument))
    try:
        value, error = caller.answers.get(timeout=seconds)
    except Empty:
        caller.calls.put(None)
        _hung.append(caller.thread)
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    _idle.append(caller)
    if error is not None:
        raise error
    return value


def pdf_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, name[, content]) of a folder's PDFs, sub-folders left out; without content no byte of them is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), *(["content"] if content else []))


def pdf_files_of(folders: DataFrame) -> DataFrame:
    """(path, name, content) of the PDFs of many folders (folder), sub-folders left out; each folder is listed and read by the task that has its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                fs, at = located(folder)
                found = fs.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True))
                for f in sorted((f for f in found if f.type == arrow_fs.FileType.File and f.base_name.endswith(".pdf")), key=lambda f: f.base_name):
                    with fs.open_input_stream(f.path) as content:
                        yield pd.DataFrame({"path": [f"{folder}/{f.base_name}"], "name": [f.base_name], "content": [content.read()]})

    return folders.select("folder").mapInPandas(run, "path string, name string, content binary")


def backend(wanted: str, layout_installed: bool) -> str:
    """Which reader to use: the layout reader where it is there, unless the flat one is asked for."""
    if wanted not in ("auto", "docling", "pymupdf"):
        raise ValueError(f"unknown backend {wanted}")
    if wanted == "docling" and not layout_installed:
        raise RuntimeError("the layout backend is not installed")
    return "docling" if wanted != "pymupdf" and layout_installed else "pymupdf"


def decode(files: DataFrame, decoder: Decoder, schema: str = RAW_BLOCKS) -> DataFrame:
    """Raw blocks of files (paper, content); the decoder is Python, a batch of files at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paper, content in zip(batch["paper"], batch["content"], strict=True):
                rows = [
                    {"paper": paper, "seq": seq, "type": kind, "page": page, "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "text": text, "size": size}
                    for seq, (page, kind, x0, y0, x1, y1, text, size) in enumerate(decoder(bytes(content)))
                ]
                if rows:
                    yield pd.DataFrame(rows)

    return files.select("paper", "content").mapInPandas(run, schema)


def decode_layout(files: DataFrame, decoder: Callable[[bytes], list[dict]]) -> DataFrame:
    """Layout items of files (paper, content); an item is a dict of the columns after ``seq``."""
    names = [x.split()[0] for x in LAYOUT_ITEMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paper, content in zip(batch["paper"], batch["content"], strict=True):
                rows = [{"paper": paper, "seq": seq} | item for seq, item in enumerate(decoder(bytes(content)))]
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names)

    return files.select("paper", "content").mapInPandas(run, LAYOUT_ITEMS)


def draw(crops: DataFrame, files: DataFrame, renderer: Callable[[bytes, int, dict, float, list[dict]], bytes]) -> DataFrame:
    """(paper, id, file, png) of crops (paper, id, source_slug, source_page, file, region, zoom, boxes) and PDFs (paper, slug, content)."""
    rows = crops.join(files.withColumnRenamed("slug", "source_slug"), ["paper", "source_slug"])
    paper = crops.schema["paper"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            png = [renderer(bytes(c), int(p), r, float(z), list(x)) for c, p, r, z, x in zip(b["content"], b["source_page"], b["region"], b["zoom"], b["boxes"], strict=True)]
            yield pd.DataFrame({"paper": b["paper"], "id": b["id"], "file": b["file"], "png": png})

    return rows.select("paper", "id", "file", "content", "source_page", "region", "zoom", "boxes").mapInPandas(run, f"paper {paper}, id int, file string, png binary")


def page_counts(pages: DataFrame) -> DataFrame:
    """(paper, pages) from the decoder's page list, one at least: pages without text count."""
    return pages.groupBy("paper").agg(F.greatest(F.count("page"), F.lit(1)).alias("pages"))


def ask(prompts: DataFrame, judge: Judge, seconds: float = JUDGE_TIMEOUT_S) -> DataFrame:
    """(paper, slug, raw, error, attempts): the judge's answer to each prompt, tried once more where the call fails or takes too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper, slug, prompt in zip(batch["paper"], batch["slug"], batch["prompt"], strict=True):
                raw = error = None
                for attempt in range(1, JUDGE_TRIES + 1):
                    try:
                        raw, error = within(judge, prompt, seconds), None
                        break
                    except (RuntimeError, ValueError, TimeoutError) as e:
                        error = f"{type(e).__name__}: {str(e)[:300]}"
                rows.append((paper, slug, raw, error, attempt))
            yield pd.DataFrame(rows, columns=["paper", "slug", "raw", "error", "attempts"])

    paper = prompts.schema["paper"].dataType.simpleString()
    return prompts.select("paper", "slug", "prompt").mapInPandas(run, f"paper {paper}, slug string, raw string, error string, attempts int")


def fetch(requests: DataFrame, get: Callable[[str], tuple[int, bytes]], seconds: float = HTTP_TIMEOUT_S) -> DataFrame:
    """(key, url, status, body, error): the answer to each request (key, url); a failure of any kind is a row, not an end.

    Requests are dealt out by a number of parts that is given: addresses are
    short and their answers slow, so parts made by size would be one or two.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, url in zip(batch["key"], batch["url"], strict=True):
                try:
                    status, body = within(get, url, seconds)
                    rows.append((key, url, status, body, None))
                except Exception as e:  # noqa: BLE001  whatever the client raises
                    rows.append((key, url, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["key", "url", "status", "body", "error"])

    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select("key", "url").repartition(parts).mapInPandas(run, "key string, url string, status int, body binary, error string")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both reach it: below the session's checkpoint folder, or on one machine in a folder made for it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marginalia-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, aside: str, place: str) -> None:
    """Rename a finished folder to its place; an error, and the folder gone, where something is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(place)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(hadoop.Path(aside), target):
        remove(spark, aside)
        raise RuntimeError(f"another run has written {place}")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the session's checkpoint folder and cut off from how they were made; on one machine a folder is made where none is set."""
    shared_folder(df.sparkSession, "kept")
    return df.checkpoint()


def pack(df: DataFrame, path: str) -> None:
    """Add rows of long texts to a folder, compressed, where a checkpoint would hold them as they are."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def portions(spark: SparkSession, path: str, text: str, most: int) -> list[list[str]]:
    """The packed files of a folder that hold rows, in runs whose texts have ``most`` bytes, or more in one file."""
    held = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum(F.octet_length(text).cast("long")).alias("n"))
    runs, n = [], 0
    for row in held.orderBy("file").collect():  # a row a file
        n += row["n"] or 0
        if not runs or n > most:
            runs.append([])
            n = row["n"] or 0
        runs[-1].append(f"{path}/{row['file']}")
    return runs


def only_new(rows: DataFrame, done: DataFrame, key: str = "paper") -> DataFrame:
    """Rows whose key has no result yet, so that a seam is not asked twice."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(schema))
