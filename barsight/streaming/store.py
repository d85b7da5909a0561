"""A table of results that grows by whole commits.

Rows are staged in a folder of their own; a commit adds the folder to the next numbered manifest,
which appears by one rename that never replaces a file. Readers take the files of one manifest, so
they see all of a commit or nothing; what an aborted run has staged is never read.
"""

import json
import os

from py4j.protocol import Py4JJavaError


class ResultStore:
    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _file(self, *names):
        return self._hadoop.Path(os.path.join(self.path, *names))

    def _system(self):
        return self._file().getFileSystem(self._conf)

    def version(self):
        """Number of the last commit; 0 before the first."""
        files, folder = self._system(), self._file("_manifests")
        if not files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def commits(self, version=None):
        """[{"key", "part"}] of a version (the last one if none is given)."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._system().open(self._file("_manifests", f"{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version=None):
        """Rows of all commits of a version."""
        parts = [os.path.join(self.path, c["part"]) for c in self.commits(version)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*parts)

    def stage(self, df):
        """Write rows to a new folder that no manifest names yet."""
        part = f"run={os.urandom(8).hex()}"
        df.write.parquet(os.path.join(self.path, part))
        return part

    def commit(self, part, key=None):
        """Make staged rows visible; a key that was committed before is not added again. Returns the version.

        If another run commits first, its manifest is read and the next number is tried.
        """
        key = key or part
        while True:
            version = self.version()
            known = self.commits(version)
            if any(c["key"] == key for c in known):
                return version
            draft = self._file("_manifests", f"_draft-{os.urandom(8).hex()}")
            out = self._system().create(draft)
            out.write(bytearray(json.dumps([*known, {"key": key, "part": part}]).encode()))
            out.close()
            if self._renamed(draft, self._file("_manifests", f"{version + 1:010d}.json")):
                return version + 1

    def append(self, df, key=None):
        return self.commit(self.stage(df), key)

    def _renamed(self, draft, final):
        """One rename that fails if the target exists."""
        rename = getattr(self._hadoop, "Options$Rename")
        choice = self.spark._sc._gateway.new_array(rename, 1)
        choice[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, choice)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._system().delete(draft, False)
            return False
