"""Learning providers from a stream of extraction files. An extension: the batch application has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import memory
from ..schema import PROVIDER_MEMORY
from ..sources import records


def learn(lines: DataFrame, memory_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of lines updates the memory table. The same batch twice gives the same memory, so a restart is harmless."""

    def update(batch: DataFrame, _: int) -> None:
        old = records.read_memory(batch.sparkSession, memory_path, PROVIDER_MEMORY)
        records.write_memory(memory.upsert_providers(old, memory.learnable(batch)), memory_path)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update).trigger(availableNow=True).start()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_seq, origen, pagina, texto) records from JSON files as they arrive."""
    return spark.readStream.schema("doc_seq long, origen string, pagina int, texto string").json(path)
