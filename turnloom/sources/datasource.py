"""Python data sources: ``spark.read.format("rttm")`` and ``format("pcm_chunks")``; a file is a partition."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .audio import CHUNK, wav_pcm


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_File]:
        path = self.options["path"]
        files = sorted(f for f in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if os.path.isfile(f))
        if not files:
            raise FileNotFoundError(path)
        return [_File(f) for f in files]


class _RttmReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                parts = line.split()
                if len(parts) >= 9 and parts[0] == "SPEAKER":
                    yield parts[1], float(parts[3]), float(parts[3]) + float(parts[4]), parts[7]


class RttmSource(DataSource):
    """Turns of RTTM files; option ``path``: a file, a folder or a pattern all executors can read."""

    @classmethod
    def name(cls) -> str:
        return "rttm"

    def schema(self) -> str:
        return "uri string, t_start double, t_end double, speaker string"

    def reader(self, schema) -> DataSourceReader:
        return _RttmReader(self.options)


class _PcmReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple]:
        size = int(self.options.get("chunk", CHUNK))
        with open(partition.path, "rb") as f:
            pcm = wav_pcm(f.read(), partition.path)
        for at in range(0, len(pcm), size):
            yield partition.path, at // size, pcm[at : at + size]


class PcmSource(DataSource):
    """Chunks of WAV or raw PCM files; options ``path`` and ``chunk`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "pcm_chunks"

    def schema(self) -> str:
        return "path string, seq bigint, pcm binary"

    def reader(self, schema) -> DataSourceReader:
        return _PcmReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RttmSource)
    spark.dataSource.register(PcmSource)
