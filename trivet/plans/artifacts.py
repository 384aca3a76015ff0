"""Several outputs of one build that appear together or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def missing(spark: SparkSession, paths: dict[str, str | None]) -> list[str]:
    """``name: path`` of sources that are not there; None is a source that is not asked for. A pattern is there when it matches."""
    out = []
    for name, path in paths.items():
        if path is not None:
            at, fs = _fs(spark, path)
            if not fs.globStatus(at):
                out.append(f"{name}: {path}")
    return out


def require(spark: SparkSession, paths: dict[str, str | None]) -> None:
    """One error that names all sources that are not there."""
    lost = missing(spark, paths)
    if lost:
        raise FileNotFoundError("missing sources: " + "; ".join(lost))


class Build:
    """A build in a folder: artifacts are written below ``build-<id>``, the manifest last. Readers go by the manifest, so they see the
    last build that was finished; :meth:`publish` replaces it in one step and then removes older ones."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.name = spark, out.rstrip("/"), f"build-{uuid.uuid4().hex}"
        self.artifacts: dict[str, str] = {}

    def path(self, artifact: str) -> str:
        """Where to write an artifact."""
        self.artifacts[artifact] = f"{self.name}/{artifact}"
        return f"{self.out}/{self.artifacts[artifact]}"

    def publish(self, **more: object) -> None:
        at, fs = _fs(self.spark, f"{self.out}/{self.name}/{MANIFEST}")
        stream = fs.create(at, True)
        stream.write(bytearray(json.dumps({"build": self.name, "artifacts": self.artifacts} | more, indent=2).encode()))
        stream.close()
        final = _fs(self.spark, f"{self.out}/{MANIFEST}")[0]
        self._replace(fs, at, final)
        for status in fs.listStatus(final.getParent()):
            name = status.getPath().getName()
            if name.startswith("build-") and name != self.name:
                fs.delete(status.getPath(), True)

    def _replace(self, fs: object, new: object, final: object) -> None:
        """In one step where the file system can; else the old manifest goes first."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        over = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        jvm.java.lang.reflect.Array.set(over, 0, jvm.java.lang.Enum.valueOf(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE"))
        context.rename(new, final, over)


def manifest(spark: SparkSession, out: str) -> dict:
    """The manifest of the last finished build."""
    at, fs = _fs(spark, f"{out.rstrip('/')}/{MANIFEST}")
    if not fs.exists(at):
        raise FileNotFoundError(f"no finished build in {out}")
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def artifact(spark: SparkSession, out: str, name: str) -> str:
    """The path of an artifact of the last finished build."""
    return f"{out.rstrip('/')}/{manifest(spark, out)['artifacts'][name]}"


def resolved(spark: SparkSession, path: str) -> str:
    """A path that exists as it is; else ``folder/name`` as the artifact ``name`` of the last finished build in ``folder``."""
    if not missing(spark, {"": path}):
        return path
    folder, _, name = path.rstrip("/").rpartition("/")
    try:
        return artifact(spark, folder, name)
    except (FileNotFoundError, KeyError):
        raise FileNotFoundError(f"missing sources: {path}") from None
