"""A data source over local git repositories: one partition a repository, read where the task runs.

    spark.dataSource.register(GitLogSource)
    spark.read.format("gitlog").option("root", "/shared/repositories").load()
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FORMAT = "%H%x1f%an%x1f%cI%x1f%B%x1e"


class RepositoryPartition(InputPartition):
    def __init__(self, name: str):
        self.name = name


def git(path: str, *args: str) -> bytes | None:
    """Output of a git command, or None if it fails."""
    got = subprocess.run(["git", "-C", path, *args], capture_output=True)
    return got.stdout if got.returncode == 0 else None


def decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("iso-8859-1")


class GitLogSource(DataSource):
    """Commits with author, committed date, stripped message and changed files; with ``blobs`` also before, after and diff of each file."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        base = "repository_name string, hash string, parent string, author string, date string, message string, modified_files_count int, modified_files array<string>"
        return base if self.options.get("blobs") != "true" else "repository_name string, hash string, file_path string, kind string, content string"

    def reader(self, schema):
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.blobs = options["root"], options.get("blobs") == "true"

    def partitions(self):
        return [RepositoryPartition(d) for d in sorted(os.listdir(self.root)) if os.path.isdir(os.path.join(self.root, d, ".git"))]

    def read(self, partition):
        path = os.path.join(self.root, partition.name)
        log = decode(git(path, "log", f"--pretty=format:{_FORMAT}")) or ""
        for entry in log.split("\x1e"):
            parts = entry.lstrip("\n").split("\x1f")
            if len(parts) != 4:
                continue
            commit, author, date, message = parts
            listed = decode(git(path, "show", "--pretty=format:", "--name-only", commit))
            files = None if listed is None else [f for f in listed.split("\n") if f]
            if self.blobs:
                for f in files or []:
                    for kind, args in (("before", ("show", f"{commit}^:{f}")), ("after", ("show", f"{commit}:{f}")), ("diff", ("show", "--patch", "--pretty=format:", commit, "--", f))):
                        yield partition.name, commit, f, kind, decode(git(path, *args))
                continue
            parent = (decode(git(path, "rev-parse", f"{commit}^")) or "").strip() or None
            yield partition.name, commit, parent, author, date, message.strip(), None if files is None else len(files), files
