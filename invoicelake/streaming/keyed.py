"""The provider memory as keyed state of a stream: each provider's entry is changed where its readings arrive, nothing else is read or written.

A reading is (clave, nif, nombre, seq, manual). Whatever the order and the micro-batches that readings arrive in: what a person wrote comes before what was
read; of either kind the one of the highest seq holds; an empty name keeps the last one that isn't empty; where all typed ones are, the name that was
read last shows, if it was read before. A reading that arrives twice changes nothing. Readings without a key or an id are left out.

The state is small, one row a provider, and lives in the state store, so a restart goes on where the checkpoint is. Changes are appended to a table; a
provider's entry is the last of its changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import memory
from ..schema import PROVIDER_MEMORY
from ..sources import records

READING = "clave string, nif string, nombre string, seq long, manual boolean"
CHANGE = f"{PROVIDER_MEMORY}, cambio long"
_SIDES = ("r", "m")
_STATE = ", ".join(f"{s}_nif string, {s}_seq long, {s}_nombre string, {s}_named long" for s in _SIDES) + ", cambio long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ProviderEntry(StatefulProcessor):
    """One provider's readings, summed up: the last of each kind, and the last names."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        old = dict(zip(names, self.entry.get())) if self.entry.exists() else dict.fromkeys(names) | {"cambio": 0}
        new = dict(old)
        for batch in rows:
            for nif, name, seq, manual in zip(batch["nif"], batch["nombre"], batch["seq"], batch["manual"]):
                side, seq, name = "m" if manual is True or manual == 1 else "r", int(seq), name if isinstance(name, str) else ""
                # of equal numbers the greater text, so that the order of arrival doesn't matter
                if new[f"{side}_seq"] is None or (seq, nif) > (new[f"{side}_seq"], new[f"{side}_nif"]):
                    new[f"{side}_seq"], new[f"{side}_nif"] = seq, nif
                if name and (new[f"{side}_named"] is None or (seq, name) > (new[f"{side}_named"], new[f"{side}_nombre"])):
                    new[f"{side}_named"], new[f"{side}_nombre"] = seq, name
        if new != old:
            new["cambio"] += 1
            self.entry.update(tuple(new[n] for n in names))
            side = "m" if new["m_seq"] is not None else "r"
            name = new[f"{side}_nombre"]
            if not name and side == "m" and new["r_named"] is not None and new["r_named"] < new["m_seq"]:
                name = new["r_nombre"]
            yield pd.DataFrame({"clave": [key[0]], "nif": [new[f"{side}_nif"]], "nombre": [name or ""], "manual": [side == "m"], "cambio": [new["cambio"]]})

    def close(self) -> None:
        pass


def readings(lines: DataFrame) -> DataFrame:
    """What a batch of lines, or a stream of them, teaches."""
    return memory.learnable(lines).select("clave", "nif", "nombre", "seq", F.lit(False).alias("manual"))


def learn(arriving: DataFrame, memory_path: str, checkpoint: str) -> StreamingQuery:
    """Takes in a stream of readings until none is left. The session's state store has to be RocksDB (``spark.sql.streaming.stateStore.providerClass``)."""
    if arriving.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {_ROCKS}")
    kept = arriving.select("clave", "nif", "nombre", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("manual", F.lit(False)).alias("manual")).filter("clave <> '' and nif <> ''")
    changed = kept.groupBy("clave").transformWithStateInPandas(ProviderEntry(), CHANGE, "Append", "None")
    return changed.writeStream.format("parquet").outputMode("append").option("path", memory_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, memory_path: str) -> DataFrame:
    """The memory (clave, nif, nombre, manual): each provider's last change."""
    if not records.is_folder(spark, memory_path):
        return spark.createDataFrame([], PROVIDER_MEMORY)
    changes = spark.read.schema(CHANGE).parquet(memory_path)
    return changes.groupBy("clave").agg(F.max_by(F.struct("nif", "nombre", "manual"), "cambio").alias("e")).select("clave", "e.*")
