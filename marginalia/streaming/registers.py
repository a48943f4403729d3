"""Registers of hits that keep arriving: what a paper's reference list does not know, kept up to date.

The keyed state of a paper is its hits so far, the keys that kept hits have
registered, and how far it has come in the hits' order.  A hit that follows all
before it is checked against the registered keys alone; one that belongs before
others changes what those may keep, so the paper's hits are gone through again.
Whichever way the hits are cut into batches, and in whatever order they come,
the last register of a paper is that of the batch operator over all of them.

A paper has a request's worth of hits (some hundred), and so has its state.
Each batch appends the whole registers of the papers it has changed, under a
rising number; ``current`` reads the last.  A hit that arrives again changes
nothing.  After a restart the checkpoint's state goes on.  A hit without a title
and a DOI has no key and is not registered; null years are undated.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T
from ..operators import scout

HIT = ["via", "title", "year", "doi", "journal", "authors"]
STATE = "ks array<string>, cited boolean, via string, title string, year int, doi string, journal string, authors string"
OUT = "paper string, number long, register string, rank int, ord int, via string, title string, year int, doi string, journal string, authors string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(found: DataFrame, papers: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits (a stream or a table, as of ``scout.hits``) with all that the state needs: order, keys, the paper's own, and whether a reference has them."""
    dois = refs.where("doi <> ''").select("paper", F.lower("doi").alias("doi")).distinct().withColumn("by_doi", F.lit(True))
    slugs = refs.where("slug <> ''").select("paper", F.col("slug").alias("author_year")).distinct().withColumn("by_slug", F.lit(True))
    own = papers.select("paper", "paper_year", T.hit_keys(F.lower(F.coalesce("paper_doi", F.lit(""))), F.col("paper_title")).alias("own"))
    rows = found.withColumn("author_year", T.author_year_key(F.col("authors"), F.col("year")))
    rows = rows.join(own, "paper", "left").join(dois, ["paper", "doi"], "left").join(slugs, ["paper", "author_year"], "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("paper").cast("string").alias("paper"), F.when(F.col("via") == "citing", 0).otherwise(1).alias("branch"), F.col("ord").cast("int").alias("ord"), T.hit_keys(F.col("doi"), F.col("title")).alias("ks"),
        F.coalesce("by_doi", "by_slug", F.lit(False)).alias("cited"), F.coalesce("paper_year", F.lit(0)).alias("paper_year"), F.coalesce("own", none).alias("own"), *HIT,
    )


class Registers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getMapState("hits", "branch int, ord int", STATE)
        self.seen = handle.getMapState("seen", "k string", "branch int, ord int")
        self.kept = handle.getMapState("kept", "branch int, ord int", "cited boolean")
        self.at = handle.getValueState("at", "branch int, ord int, number long, paper_year int, own array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at = self.at.get() if self.at.exists() else None
        last, number, paper_year, own = ((at[0], at[1]), at[2], at[3], list(at[4])) if at else ((-1, -1), 0, None, None)
        new = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                place = (int(r.branch), int(r.ord))
                if paper_year is None:
                    paper_year, own = int(r.paper_year), list(r.own)
                if place not in new and not self.hits.containsKey(place):
                    new[place] = (list(r.ks), bool(r.cited), r.via, r.title, None if pd.isna(r.year) else int(r.year), r.doi, r.journal, r.authors)
        if not new:
            return
        for place, hit in new.items():
            self.hits.updateValue(place, hit)
        order = sorted(new)
        if order[0] < last:
            # what came before may now be a copy of a new hit
            for k in [tuple(k) for k in self.seen.keys()]:
                self.seen.removeKey(k)
            for k in [tuple(k) for k in self.kept.keys()]:
                self.kept.removeKey(k)
            order = sorted((int(k[0]), int(k[1])) for k in self.hits.keys())
        for place in order:
            ks, cited = (lambda h: (list(h[0]), bool(h[1])))(self.hits.getValue(place))
            if ks and not any(k in own or self.seen.containsKey((k,)) for k in ks):
                for k in ks:
                    self.seen.updateValue((k,), place)
                self.kept.updateValue(place, (cited,))
        self.at.update((*max(last, order[-1]), number + 1, paper_year, own))
        yield self._registers(str(key[0]), number + 1, paper_year)

    def _registers(self, paper: str, number: int, paper_year: int) -> pd.DataFrame:
        lists: dict[str, list] = {"newer": [], "overlooked": []}
        for place in self.kept.keys():
            place = (int(place[0]), int(place[1]))
            _, cited, via, title, year, doi, journal, authors = self.hits.getValue(place)
            row = (place[1], via, title, year, doi, journal, authors)
            if via == "citing" or year is not None and paper_year and year > paper_year:
                lists["newer"].append((place[0], row))
            elif year is not None and not cited:
                lists["overlooked"].append((place[0], row))
        out = []
        for name, cap in (("newer", scout.NEWER_CAP), ("overlooked", scout.OVERLOOKED_CAP)):
            ordered = sorted(lists[name], key=lambda x: (-(x[1][3] or 0), x[1][2], x[0], x[1][0]))
            out += [(paper, number, name, k, *row) for k, (_, row) in enumerate(ordered[:cap], 1)]
        # a paper whose registers have become empty says so
        out = out or [(paper, number, "none", 0, 0, None, None, None, None, None, None)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return frame.astype({"year": "Int32"})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state of this kind needs the RocksDB store; a query keeps the store that it was started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def register_stream(found: DataFrame, papers: DataFrame, refs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run the registers on a stream of hits until what is there is done; ``out`` gets their rows as Parquet."""
    rows = prepared(found, papers, refs).groupBy("paper").transformWithStateInPandas(Registers(), OUT, "Append", "None")
    with _rocks(found.sparkSession):
        return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last registers of each paper."""
    rows = spark.read.schema(OUT).parquet(out)
    last = rows.groupBy("paper").agg(F.max("number").alias("number"))
    return rows.join(last, ["paper", "number"]).where("register <> 'none'").drop("number")
