"""Many reports at once: their pieces as rows, and the sink that writes them.

Tasks write into a folder of the job's own; a commit moves the files to their places,
an abort removes the folder, so a failed job leaves nothing behind. Files are reached
through Arrow's file systems, local or remote, by the URI of the root.
"""

import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.relational import entry_order, row_numbers
from ..session import materialize
from .reports import collection_head, entry_block

PIECES = "path string, place long, text string"


def collection_reports(entries: DataFrame) -> DataFrame:
    """(path, place, text): the pieces of every day's report, {day}.md, in order.

    ``entries`` as for ``collection_report``, with ``day`` as text. Entries are numbered
    by ranges over all days, so neither a day nor a topic is gathered; a day's head is
    made of its row per topic. The pieces of a day put together are its report.
    """
    topics = materialize(entries.groupBy("day", "topic").agg(F.count("*").alias("n"), F.max("score").alias("best")), "day-topics")
    order = Window.partitionBy("day").orderBy(F.desc("best"), "topic")  # a row per topic of the taxonomy
    placed = entries.join(topics.withColumn("topic_place", F.row_number().over(order)), ["day", "topic"])
    numbered = row_numbers(placed, [F.col("day"), F.col("topic_place"), *entry_order()], "place")
    starts = numbered.groupBy("day", "topic").agg(F.min("place").alias("_first"))
    title = F.when(F.col("place") == F.col("_first"), F.concat(F.lit("\n## "), "topic", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"))).otherwise("")
    blocks = numbered.join(starts, ["day", "topic"]).select("day", F.col("place").cast("long").alias("place"), F.concat(title, F.lit("\n"), entry_block(), F.lit("\n")).alias("text"))

    def heads(frames):
        for frame in frames:
            text = [collection_head(d, {c["topic"]: int(c["n"]) for c in counts}) for d, counts in zip(frame["day"], frame["counts"])]
            yield pd.DataFrame({"day": frame["day"], "place": 0, "text": text})

    head = topics.groupBy("day").agg(F.collect_list(F.struct("topic", "n")).alias("counts")).mapInPandas(heads, "day string, place long, text string")
    return head.unionByName(blocks).select(F.concat("day", F.lit(".md")).alias("path"), "place", "text")


def write_reports(pieces: DataFrame, root: str) -> None:
    """Writes (path, place, text) as files below ``root``; a file that is there is
    replaced. The pieces of a path pass through one task, one after another."""
    pieces.sparkSession.dataSource.register(TextFiles)
    pieces.repartition("path").sortWithinPartitions("path", "place").write.format("quill_text").option("root", root).mode("append").save()


class TextFiles(DataSource):
    """Text files from rows of PIECES that come in order of path and place."""

    @classmethod
    def name(cls):
        return "quill_text"

    def schema(self):
        return PIECES

    def writer(self, schema, overwrite):
        return _Writer(self.options["root"])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root if "://" in root else f"file://{root}"
        self.job = f".writing-{uuid.uuid4().hex}"

    def _place(self):
        return fs.FileSystem.from_uri(self.root)

    def write(self, rows):
        system, base = self._place()
        files, out, at = [], None, None
        try:
            for row in rows:
                if row["path"] != at:
                    if out:
                        out.close()
                    at = row["path"]
                    files.append((f"{base}/{self.job}/{uuid.uuid4().hex}", at))
                    system.create_dir(f"{base}/{self.job}", recursive=True)
                    out = system.open_output_stream(files[-1][0])
                out.write(row["text"].encode())
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages):
        system, base = self._place()
        for written, path in [f for m in messages if m for f in m.files]:
            system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
            system.move(written, f"{base}/{path}")
        self._clear(system, base)

    def abort(self, messages):
        self._clear(*self._place())

    def _clear(self, system, base):
        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")
