"""WebVTT files: reader and sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tierloom.functions.chunks import chunk_of, rank_in_groups
from tierloom.functions.text import file_stem, strip
from tierloom.functions.timecode import ms_to_stamp, stamp_to_ms

# Fixed value: a cue is two stamps, then text up to a blank line or the end.
CUE_PATTERN = (r"(?s)(\d{2}:\d{2}:\d{2}\.\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s*\n(.*?)"
               r"(?=\n\n|\z)")


#: Ending of the name of a file that continues a document.
GOES_ON = r"~from(\d+)$"


def cues_of_text(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per non-empty cue of each file: path, stem, cue_no, start_ms, end_ms, text.

    A file named ``<stem>~from<n>.vtt`` goes on with a document at cue n.
    """
    whole = F.regexp_replace(F.col(content), "\r\n?", "\n")

    def group(i: int):
        return F.regexp_extract_all(whole, F.lit(CUE_PATTERN), F.lit(i))

    cues = F.arrays_zip(group(1).alias("start"), group(2).alias("end"), group(3).alias("text"))
    rows = files.select(F.col(path).alias("path"), F.posexplode(cues).alias("cue_no", "c"))
    name = file_stem("path")
    first = F.coalesce(F.nullif(F.regexp_extract(name, GOES_ON, 1), F.lit("")).cast("long"), F.lit(0))
    return rows.select(
        "path", F.regexp_replace(name, GOES_ON, "").alias("stem"), (F.col("cue_no") + first).alias("cue_no"),
        stamp_to_ms("c.start").alias("start_ms"), stamp_to_ms("c.end").alias("end_ms"),
        strip("c.text").alias("text")).filter("text <> ''")


def read_webvtt(spark: SparkSession, folder: str) -> DataFrame:
    """All WebVTT files below a folder; a file is one row because a cue spans lines."""
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.vtt").load(folder))
    return cues_of_text(vtt_files(files))


def vtt_files(files: DataFrame) -> DataFrame:
    """``path`` and ``content`` of whole text files; the path is written as it is, not as an address."""
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return files.select(plain.alias("path"), F.col("value").alias("content"))


def webvtt_blocks(cues: DataFrame) -> DataFrame:
    """Numbered blocks of each document: block 0 is the header, then one block per cue.

    A document is kept as ordered blocks, so a very long one never becomes one string.
    """
    rows = rank_in_groups(cues, ["stem"], F.floor(F.col("start_ms") / 600_000),
                          [F.col("start_ms"), F.col("cue_no")], "pos")
    n = (F.col("pos") + 1).alias("n")
    block = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), ms_to_stamp("start_ms"), F.lit(" --> "),
                     ms_to_stamp("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    head = cues.select("stem").distinct().select("stem", F.lit(0).cast("long").alias("n"),
                                                 F.lit("WEBVTT\n").alias("block"))
    return head.unionByName(rows.select("stem", n, block.alias("block")))


def write_webvtt(cues: DataFrame, folder: str, most: int = 1_000_000) -> None:
    """Write one document ``<stem>.vtt`` per video, which ``read_webvtt`` reads back.

    Blocks are written one after the other, so a document is never held as a whole. A video of more than
    ``most`` blocks goes on in ``<stem>~from<n>.vtt``, where n is the number of its first cue, so that it is
    not sorted in one task. Files of the folder are replaced when all documents are written. Stems must not
    hold a slash or be null. A blank line inside a text would end the cue, so runs of line ends become one.
    """
    cues.sparkSession.dataSource.register(WebVttSource)
    tidy = cues.withColumn("text", F.regexp_replace("text", r"(\r\n?|\n)[\r\n]*", "\n"))
    piece = chunk_of("n", most)
    name = F.when(F.col("_piece") > 0, F.concat(F.col("stem"), F.lit("~from"), (F.col("_piece") * most - 1).cast("string"))).otherwise(F.col("stem"))
    blocks = webvtt_blocks(tidy.withColumn("stem", F.col("stem").cast("string"))).withColumn("_piece", piece)
    rows = blocks.select(name.alias("document"), "n", "block")
    dealt = rows.repartition("document").sortWithinPartitions("document", "n")
    dealt.write.format("webvtt").option("path", folder).mode("overwrite").save()


class WebVttSource(DataSource):
    """Sink for rows (document, n, block) that lie together and in order per document.

    Tasks write into a staging folder; files get their names when the job commits, so a reader never sees a
    document of a task that failed, and a task that runs twice leaves one copy.
    """

    @classmethod
    def name(cls) -> str:
        return "webvtt"

    def schema(self) -> str:
        return "document string, n long, block string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WebVttWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class WebVttWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._store()
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names: list[str] = []
        for document, rows in groupby(iterator, lambda r: r["document"]):
            names.append(f"{document}.vtt")
            with store.open_output_stream(f"{own}/{names[-1]}") as out:
                for i, row in enumerate(rows):
                    out.write((("\n" if i else "") + row["block"]).encode())
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(FileSelector(root)):
                if info.is_file and info.path.endswith(".vtt"):
                    store.delete_file(info.path)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{message.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")
