"""The folder that the driver and all executors share, and small file operations in whatever store it lies."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on a local master (tests, a laptop) a temporary one is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="findloom-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs no recomputation of what made it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(stored: DataFrame, task_bytes: int) -> int:
    """Tasks for a shuffle of a stored table: as many as give each about `task_bytes` of its files, and no fewer than the session's own number."""
    spark = stored.sparkSession
    size = sum(sum(Files(spark, folder).sizes().values()) for folder in {path.rsplit("/", 1)[0] for path in stored.inputFiles()})
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


class Files:
    """Files of a folder through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.folder = self.path(folder)
        self.fs = self.folder.getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.folder)) if self.fs.exists(self.folder) else []

    def sizes(self) -> dict[str, int]:
        """Path -> bytes of all files below the folder."""
        out, found = {}, self.fs.listFiles(self.folder, True)
        while found.hasNext():
            f = found.next()
            out[f.getPath().toString()] = f.getLen()
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.folder.toString(), name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a file whole, in one step; False if there is one of that name."""
        self.fs.mkdirs(self.folder)
        aside, final = (self.path(self.folder.toString(), n) for n in (f".{uuid.uuid4().hex}", name))
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                # A rename on a local disk would overwrite; a second link to a name that is taken fails.
                local = lambda p: self.jvm.java.nio.file.Path.of(p.toUri())
                self.jvm.java.nio.file.Files.createLink(local(self.fs.makeQualified(final)), local(self.fs.makeQualified(aside)))
            else:
                plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(aside, final, plain)
            return True
        except Exception:
            if self.fs.exists(final):
                return False
            raise
        finally:
            self.fs.delete(aside, False)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(self.folder.toString(), name) if name else self.folder, True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file below the paths is added, removed or written anew: a digest of their names, lengths and times."""
    digest = hashlib.sha256()
    for path in paths:
        files = Files(spark, path)
        found = files.fs.listFiles(files.folder, True)
        lines = []
        while found.hasNext():
            f = found.next()
            lines.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join(sorted(lines)).encode())
    return digest.hexdigest()[:24]
