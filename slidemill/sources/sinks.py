"""Files written by tasks and committed by the driver: a Spark data source whose parts are staged until all have succeeded.

A task writes its files to a folder of its own below `_staging`; only what successful attempts report is moved to its
final name, by the driver, once all tasks are done. A failed job leaves nothing behind, a task that runs again leaves no
second copy. What a task writes is up to a FileSink.
"""

from __future__ import annotations

import base64
import json
import tarfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from slidemill.sources.files import store_of

#: Table of what a job wrote, one JSON object for each file; it stands beside the files once they all do.
MANIFEST = "files.json"
STAGING = "_staging"
#: Moves that the driver makes at once.
MOVES = 32


class FileSink:
    """What tasks write. write() takes a task's rows, opens files by create(final name) and yields facts of each file it has closed, as a dict of plain values; names must be the task's own."""

    def write(self, rows: Iterator[Row], create: Callable) -> Iterator[dict]:
        raise NotImplementedError


class TarSink(FileSink):
    """rows(shard_id, key, encoded, meta), sorted by shard, to shard-000000.tar and so on; a member at a time is in memory."""

    def write(self, rows: Iterator[Row], create: Callable) -> Iterator[dict]:
        import io

        held, tar, out, n = None, None, None, 0

        def closed() -> dict:
            tar.close()
            out.close()
            return {"shard_id": held, "n": n}

        for r in rows:
            if r["shard_id"] != held:
                if tar is not None:
                    yield closed()
                held, n, out = r["shard_id"], 0, create(f"shard-{r['shard_id']:06d}.tar")
                tar = tarfile.open(fileobj=out, mode="w|")
            for suffix, data in (("png", bytes(r["encoded"])), ("json", r["meta"].encode())):
                info = tarfile.TarInfo(f"{r['key']}.{suffix}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            n += 1
        if tar is not None:
            yield closed()


@dataclass
class Staged(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)


class StagedWriter(DataSourceWriter):
    def __init__(self, sink: FileSink, outdir: str, overwrite: bool):
        self.sink, self.outdir, self.overwrite = sink, outdir, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = store_of(self.outdir)
        folder = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        names: list[str] = []

        def create(name: str):
            if not names:
                store.create_dir(folder, recursive=True)
            names.append(name)
            return store.open_output_stream(f"{folder}/{name}")

        facts = list(self.sink.write(iterator, create))
        return Staged(folder, names, facts)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.outdir)
        store.create_dir(root, recursive=True)
        told = [m for m in messages if m is not None]
        names = [n for m in told for n in m.names]
        if len(set(names)) != len(names):
            raise ValueError("two tasks wrote files of one name")
        old = {f.base_name: f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file}
        if not self.overwrite and (both := sorted(set(names) & set(old))):
            raise FileExistsError(f"{self.outdir} has {both[:3]} already")
        if self.overwrite and MANIFEST in old:  # what an earlier job said it wrote goes
            with store.open_input_stream(old[MANIFEST]) as f:
                for name in {json.loads(x)["file"] for x in f.read().decode().splitlines() if x} & set(old):
                    store.delete_file(old[name])
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda x: store.move(*x), [(f"{m.folder}/{n}", f"{root}/{n}") for m in told for n in m.names]))
        lines = [json.dumps({"file": n, **facts}) for m in told for n, facts in zip(m.names, m.facts, strict=True)]
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write("".join(x + "\n" for x in lines).encode())
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*store_of(self.outdir))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        at = f"{root}/{STAGING}"
        if store.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.job}")
            if not store.get_file_info(fs.FileSelector(at)):
                store.delete_dir(at)


class StagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "file string"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(cloudpickle.loads(base64.b64decode(self.options["sink"])), self.options["outdir"], overwrite)


def write_files(rows: DataFrame, sink: FileSink, outdir: str, facts: str, overwrite: bool = False) -> DataFrame:
    """Write rows by the sink to outdir, which all executors and the driver share: file and the facts (a schema) of each file. Files of the same names are an error, or with overwrite go with all that the last job wrote."""
    spark = rows.sparkSession
    spark.dataSource.register(StagedFiles)
    rows.write.format("staged_files").options(sink=base64.b64encode(cloudpickle.dumps(sink)).decode(), outdir=outdir).mode("overwrite" if overwrite else "append").save()
    return spark.read.schema(f"file string, {facts}").json(f"{outdir}/{MANIFEST}")
