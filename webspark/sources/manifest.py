"""A log of small entries that several writers may add to, each entry once.

An entry is a JSON file under a name that all writers would use for it, such as the number of a version. It
appears whole or not at all, and only if no other writer was first: publishing is a put-if-absent. A local or
mounted folder links a finished file to the name, which fails if the name is taken; other file systems rename
a finished file without permission to overwrite, which their name node decides. Nothing relies on the rename
of a folder, nor on a listing being fresh: a listing only says what to read, the name says who was first.
"""

from __future__ import annotations

import json
import os
from pathlib import Path
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import SparkSession


class ManifestLog:
    """Entries under ``path``. Beyond local folders it takes the JVM of a classic session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        place = urlparse(self.path)
        self.local = Path(place.path) if place.scheme in ("", "file") and self._default_is_local(place.scheme) else None

    def _default_is_local(self, scheme: str) -> bool:
        return scheme == "file" or self._jvm_files()[1].getUri().getScheme() == "file"

    def _jvm_files(self):
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), conf

    def entries(self) -> dict[str, dict]:
        """Name and content of every entry."""
        if self.local is not None:
            files = self.local.glob("*.json") if self.local.exists() else []
            return {f.name[:-5]: content for f in files if (content := self._local_content(f)) is not None}
        fs, files, _ = self._jvm_files()
        root = fs.Path(self.path)
        if not files.exists(root):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(root)]
        named = [n for n in names if n.endswith(".json")]
        if not named:
            return {}
        # Few small files: what is older than the last two bases is removed.
        texts = self.spark.sparkContext.wholeTextFiles(",".join(f"{self.path}/{n}" for n in named)).collect()
        return {p.rsplit("/", 1)[1][:-5]: json.loads(t) for p, t in texts}

    @staticmethod
    def _local_content(file: Path) -> dict | None:
        """Content, or None where a compaction has just removed the entry."""
        try:
            return json.loads(file.read_text())
        except FileNotFoundError:
            return None

    def put(self, name: str, content: dict) -> bool:
        """Publish an entry; False if there is one of this name."""
        text, draft = json.dumps(content), f"draft-{uuid4().hex}"
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
            made = self.local / draft
            made.write_text(text)
            try:
                os.link(made, self.local / f"{name}.json")
            except FileExistsError:
                return False
            finally:
                made.unlink()
            return True
        return self._put_by_rename(name, text, draft)

    def _put_by_rename(self, name: str, text: str, draft: str) -> bool:
        fs, files, conf = self._jvm_files()
        source, target = fs.Path(f"{self.path}/{draft}"), fs.Path(f"{self.path}/{name}.json")
        out = files.create(source, False)
        out.write(text.encode())
        out.close()
        context = fs.FileContext.getFileContext(files.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(source, target, none)
        except Exception as error:
            files.delete(source, False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        if self.local is not None:
            (self.local / f"{name}.json").unlink(missing_ok=True)
        else:
            fs, files, _ = self._jvm_files()
            files.delete(fs.Path(f"{self.path}/{name}.json"), False)
