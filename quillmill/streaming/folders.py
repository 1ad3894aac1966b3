"""A watched folder as a stream: new files are converted once each and their originals archived."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.convert import convert
from ..settings import Corrections, Settings, corrections_from
from ..sources.files import read_small_texts
from ..sources.kinds import EXTENSIONS, extension_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, archive: str | None = None, files_at_once: int = 1000) -> DataFrame:
    """The folder's files as they come. With ``archive`` the originals move there once they are done."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder)
    name_ok = extension_of(files["path"]).isin(*EXTENSIONS)
    return files.filter(name_ok & ~files["path"].rlike(r"/\.[^/]*$"))


class Progress(StreamingQueryListener):
    """Counts processed and failed files, and keeps the last error: of a file, or of the stream itself.

    Given to convert_stream it learns of files; added to the session's listeners it learns how the stream goes.
    """

    def __init__(self):
        self.processed, self.failed, self.last_error = 0, 0, None

    def note(self, results: DataFrame) -> None:
        """Take in a batch's results."""
        failed = results.filter("status = 'failed'")
        text = F.concat("path", F.lit(": "), F.coalesce("message", "error", F.lit("failed")))
        count, last = failed.agg(F.count("*"), F.max_by(text, "path")).first()
        self.failed += count
        self.last_error = last or self.last_error

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.processed += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last_error = event.exception or self.last_error


def convert_stream(
    files: DataFrame, output: str, checkpoint: str, settings: Settings | None = None, dictionary: str | None = None,
    also: Callable[[DataFrame, int, Settings], None] | None = None, once: bool = False, progress: Progress | None = None,
) -> StreamingQuery:
    """Convert every file once, across restarts, to Parquet folders by batch below ``output``.

    A batch that runs again replaces its own folder. Files that can't be converted are rows with an error and are not
    tried again; ``progress`` counts them and keeps the last one's error. ``also`` gets each batch's results, its number
    and the settings, with ``dictionary`` read anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = settings or Settings()
        if dictionary:
            held = replace(held, corrections=load_dictionary(spark, dictionary))
        place = f"{output}/batch={number}"
        convert(batch, held).write.mode("overwrite").parquet(place)
        if progress:
            progress.note(spark.read.parquet(place))
        if also:
            also(spark.read.parquet(place), number, held)

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def load_dictionary(spark: SparkSession, path: str) -> Corrections:
    texts = list(read_small_texts(spark, path).values())
    return corrections_from(texts[0]) if texts else Corrections()
