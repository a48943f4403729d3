"""A ledger of requests: each distinct address is asked once, each host at its own pace.

Answers are appended to a folder under the digest of their address.  An address
that is there already is never asked again, by whatever reference, stage or
session; of the others each is asked once, however many references name it.
Requests are dealt to lanes by host, one task a lane, so that a host is asked
by one task at a time, with ``pace`` seconds between the starts of two requests
(also across rounds, stages and sessions) and longer after it refused: twice as
long at each try.  Hosts don't wait for each other unless they share a task.

A host's lane is as long as the host allows; that is the point of it, so a host
with most requests isn't split.  Rounds of ``round_size`` requests are written
one after the other: a lost executor or driver costs a round at most, and a
repeated task repeats its lane of that round.  Speculative execution would ask
twice and has to be off.  Null addresses are not asked; an address without a
host is a lane of its own and fails as a row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seams

LEDGER = "digest string, url string, host string, status int, body binary, error string, tries int, asked double"
#: Statuses that ask for patience, tries of one request, and the longest wait between two.
REFUSED, TRIES, LONGEST_S = (429, 500, 502, 503, 504), 3, 60.0
ROUND = 10_000


def _lane(get: Callable[[str], tuple[int, bytes]], pace: float, tries: int, seconds: float):
    """Asks for the rows of a partition one after the other; rows: digest, url, host, after (when the host was last asked)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, float] = {}
        for batch in batches:
            rows = []
            for digest, url, host, after in zip(batch["digest"], batch["url"], batch["host"], batch["after"], strict=True):
                status = body = error = None
                for attempt in range(1, tries + 1):
                    time.sleep(max(0.0, ready.get(host, (after or 0.0) + pace) - time.time()))
                    asked = time.time()
                    try:
                        status, body = seams.within(get, url, seconds)
                        error = None
                    except Exception as e:  # noqa: BLE001  whatever the client raises
                        status, body, error = None, None, type(e).__name__
                    again = error is not None or status in REFUSED
                    ready[host] = asked + (min(LONGEST_S, pace * 2**attempt) if again else pace)
                    if not again:
                        break
                rows.append((digest, url, host, status, body, error, attempt, asked))
            out = pd.DataFrame(rows, columns=["digest", "url", "host", "status", "body", "error", "tries", "asked"])
            yield out.astype({"status": "Int32"})

    return run


class RequestLedger:
    """The ledger in a folder that driver and executors share; get: address to (status, body)."""

    def __init__(self, spark: SparkSession, path: str, get: Callable[[str], tuple[int, bytes]], pace: float = 1.0, tries: int = TRIES, seconds: float = seams.HTTP_TIMEOUT_S, round_size: int = ROUND):
        self.spark, self.path = spark, path.rstrip("/")
        self.get, self.pace, self.tries, self.seconds, self.round_size = get, pace, tries, seconds, round_size

    def rows(self) -> DataFrame:
        """What was asked: one row an address, its latest answer."""
        try:
            rows = self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return seams.empty(self.spark, LEDGER)
        rest = [c for c in rows.columns if c != "digest"]
        return rows.groupBy("digest").agg(F.max_by(F.struct(*rest), "asked").alias("r")).select("digest", "r.*")

    def fetch(self, urls: DataFrame, again: bool = False) -> DataFrame:
        """(url, status, body, error) of each distinct address in ``urls``; ``again``: also ask those anew that have failed."""
        wanted = urls.where("url is not null").select("url").distinct().withColumn("digest", F.sha2("url", 256))
        known = self.rows()
        if again:
            known = known.where(F.col("error").isNull() & ~F.col("status").isin(*REFUSED))
        host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
        missing = wanted.join(known.select("digest"), "digest", "left_anti").withColumn("host", host)
        missing = seams.kept(missing)
        rounds = -(-missing.count() // self.round_size)
        for k in range(rounds):
            last = self.rows().groupBy("host").agg(F.max("asked").alias("after"))
            own = missing.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == k).join(last, "host", "left")
            lanes = own.select("digest", "url", "host", "after").repartition("host").sortWithinPartitions("host", "digest")
            lanes.mapInPandas(_lane(self.get, self.pace, self.tries, self.seconds), LEDGER).write.mode("append").parquet(self.path)
        return wanted.join(self.rows().drop("url"), "digest").select("url", "status", "body", "error")
