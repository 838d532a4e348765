"""Streams: admission of observations as keyed state, a sink into the store, counts over event time, and a followed decision log."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from engramma.functions import hv
from engramma.functions import text as tx
from engramma.operators import recall, surprise
from engramma.operators.ingest import VETO
from engramma.sources.snapshots import Store, parse_log

KEEP = 4096
DECISIONS = "namespace string, seq long, novelty double, surprise double, predictable boolean, stored boolean, reinforces long"
#: State as lists and maps needs this provider, set for the session that starts the query.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Admission(StatefulProcessor):
    """Of a name space: vectors of stored rows (a list, only ever appended to), counts of words, pairs and contexts (a map), and the last scores."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vectors = handle.getListState("vectors", "seq long, hv binary")
        self.counts = handle.getMapState("counts", "kind string, a string, b string", "n long")
        self.scores = handle.getValueState("scores", "scores array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        scores = self._surprise(frame)
        last = list(self.scores.get()[0]) if self.scores.exists() else []
        placed = pd.DataFrame({"namespace": key[0], "seq": 0, "n_tokens": 0, "surprise": [*last, *scores], "place": range(len(last) + len(scores)), "own": [False] * len(last) + [True] * len(scores), "home": 0, "chunk": 0})
        predictable = surprise._judged(None, placed)["predictable"].to_numpy(bool)
        self.scores.update((placed["surprise"].tolist()[-surprise.HISTORY :],))
        yield self._novelty(key[0], frame, scores, predictable)

    def _surprise(self, frame: pd.DataFrame) -> np.ndarray:
        """Scores of the rows in order; the words' counts are read and written once a micro-batch."""
        new: dict[tuple, int] = {}
        for words in frame["tokens"]:
            for prev, t in zip([None, *words], words, strict=False):
                for k in [("w", t, ""), ("t", "", "")] + ([("p", prev, t), ("c", prev, "")] if prev is not None else []):
                    new[k] = new.get(k, 0) + 1
        before = {k: (self.counts.getValue(k) or (0,))[0] if self.counts.containsKey(k) else 0 for k in new}
        for k, n in new.items():
            self.counts.updateValue(k, (before[k] + n,))
        prior = pd.DataFrame([(*k, n) for k, n in before.items()], columns=["kind", "a", "b", "prior"])
        return surprise._span_bits(None, frame, prior)["surprise"].to_numpy()

    def _novelty(self, space: str, frame: pd.DataFrame, scores: np.ndarray, predictable: np.ndarray) -> pd.DataFrame:
        """Each row against all stored ones, which are read in blocks, then against those stored before it in this micro-batch."""
        m, seqs = recall.matrix(frame["hv"]), frame["seq"].tolist()
        best: list[tuple[float, int]] = [(-1.0, 0)] * len(frame)
        stored = iter(self.vectors.get())
        while block := list(islice(stored, self.keep)):
            ids, held = np.array([r[0] for r in block]), recall.matrix(pd.Series([bytes(r[1]) for r in block]))
            for i, v in enumerate(m):
                sim = recall.alike(v, held, hv.BITS)
                at = np.lexsort((ids, -sim))[0]
                best[i] = max(best[i], (float(sim[at]), -int(ids[at])))
        kept, out = [], []
        for i, seq in enumerate(seqs):
            if kept:
                sim = recall.alike(m[i], m[kept], hv.BITS)
                at = int(sim.argmax())
                best[i] = max(best[i], (float(sim[at]), -int(seqs[kept[at]])))
            novelty = 1.0 - best[i][0] if best[i][0] >= 0 else 1.0
            if keep := novelty >= VETO and not predictable[i]:
                kept.append(i)
            out.append((space, seq, round(novelty, 6), scores[i], bool(predictable[i]), bool(keep), -best[i][1] if novelty < VETO else None))
        if kept:
            self.vectors.appendList([(seqs[i], frame["hv"].iloc[i]) for i in kept])
        got = pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])
        return got.assign(reinforces=got["reinforces"].astype("Int64"))

    def close(self) -> None:
        pass


def admit_stream(observations: DataFrame, keep: int = KEEP) -> DataFrame:
    """`ingest.admit` of a stream (namespace, seq, text), in order of micro-batches and of seq in each: DECISIONS.

    The state is appended to, not rewritten, and has no bound: stored vectors are read `keep` at a time. Needs PROVIDER."""
    rows = observations.select("namespace", "seq", F.coalesce(tx.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"), hv.encoder()(F.coalesce("text", F.lit(""))).alias("hv"))
    return rows.groupBy("namespace").transformWithStateInPandas(Admission(keep), DECISIONS, "Append", "None")


def into_store(stream: DataFrame, store: Store, table: str, name: str) -> DataStreamWriter:
    """A sink that writes each micro-batch as a delta of a table of the store. The number of the batch stands in the version's manifest, so a batch that comes again,
    after a crash or a restart, changes nothing: each row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, store.root).apply({table: batch}, batch=(name, number))

    return stream.writeStream.foreachBatch(write).queryName(name)


def activity(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Accesses by event type and window; late rows beyond the watermark are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def follow_log(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of a growing folder of decision logs, parsed."""
    return parse_log(spark.readStream.text(folder))
