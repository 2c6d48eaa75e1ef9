"""A sink that writes each analysis's report files from the executors: staged by task, put in place when all tasks are done."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "change_reports"
LINES = "analysis_id string, file string, entry string, line string"


@dataclass
class Staged(WriterCommitMessage):
    """(staged file, place) of what a task has written."""

    files: list[tuple[str, str]]


class ReportSource(DataSource):
    """Rows (analysis_id, file, entry, line) in order, an analysis's in one partition: `file` is written under the folder of the
    analysis, as lines ended by LF or, if its name ends in .zip, as an archive whose entries have lines ended by CR LF.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"])


class ReportWriter(DataSourceWriter):
    """Two phases: tasks write into a folder of this job's own, commit() moves the files of tasks that succeeded, abort() drops it. Files of an
    attempt that failed or lost a race are in no message and go with the folder.
    """

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, rows: Iterator[Row]) -> Staged:
        system, root = self._system()
        staged = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(staged)
        done, now, out, archive, entry = [], None, None, None, None

        def close() -> None:
            nonlocal out, archive, entry
            for x in (entry, archive, out):
                if x is not None:
                    x.close()
            out = archive = entry = None

        try:
            for r in rows:
                if (r["analysis_id"], r["file"]) != now:
                    close()
                    now, opened = (r["analysis_id"], r["file"]), None
                    path = f"{staged}/{len(done)}"
                    done.append((path, f"{root}/{r['analysis_id']}/{r['file']}"))
                    out = system.open_output_stream(path)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if r["file"].endswith(".zip") else None
                if archive is not None:
                    if r["entry"] != opened:
                        if entry is not None:
                            entry.close()
                        # one date for all entries, so that equal reports are equal files
                        entry, opened = archive.open(zipfile.ZipInfo(r["entry"]), "w"), r["entry"]
                    entry.write((r["line"] + "\r\n").encode())
                else:
                    out.write((r["line"] + "\n").encode())
        finally:
            close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._system()
        for m in messages:
            for path, place in m.files if m else []:
                system.create_dir(place.rpartition("/")[0])
                system.move(path, place)
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._system())

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_staged-{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_staged-{self.job}")


def csv_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """analysis_id, file, entry, ord, line: CSV sets (analysis_id, ord, columns of text) as entries of data.zip, each with its header."""
    out = None
    for name, df in tables.items():
        columns = [c for c in df.columns if c not in ("analysis_id", "ord")]
        line = F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
        d = df.select(F.col("analysis_id").cast("string").alias("analysis_id"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
        d = d.unionByName(d.select("analysis_id").distinct().withColumns({"ord": F.lit(-1).cast("long"), "line": F.lit(",".join(columns))}))
        d = d.select("analysis_id", F.lit("data.zip").alias("file"), F.lit(f"{name}.csv").alias("entry"), "ord", "line")
        out = d if out is None else out.unionByName(d)
    return out


def write_reports(lines: DataFrame, folder: str) -> None:
    """Lines (analysis_id, file, entry, ord, line) into files under folder/analysis_id; files that are there are replaced."""
    lines.sparkSession.dataSource.register(ReportSource)
    d = lines.repartition("analysis_id").sortWithinPartitions("analysis_id", "file", "entry", "ord")
    d.select("analysis_id", "file", "entry", "line").write.format(FORMAT).mode("append").option("path", folder).save()
