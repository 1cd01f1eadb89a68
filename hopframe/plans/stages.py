"""A graph of stored stages, named by content: what goes in, with which parameters, by which version of the code.

A stage's folder is called by a digest of its parameters, its version and the digests of its inputs, so an equal stage is
never computed twice and a different one never takes another's place. A stage is written beside its folder and moved
there when it's whole; an identity file says what it is and is held against what is asked for, so a folder that was
edited by hand is refused. Sources are named by the files they consist of (names, sizes, times of change)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import runtime


class StageError(ValueError):
    pass


def _digest(what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class Stage:
    name: str
    make: Callable[..., DataFrame]  # takes the inputs' tables, then the parameters by name
    inputs: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    version: int = 1


@dataclass
class Graph:
    """Sources (paths of parquet tables) and stages of a run below a root folder. `made` and `reused` list what `table` did."""

    spark: SparkSession
    root: str
    sources: dict[str, str]
    stages: dict[str, Stage] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    _sources: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, make: Callable[..., DataFrame], inputs: list[str], version: int = 1, **parameters) -> Graph:
        lacking = [i for i in inputs if i not in self.stages and i not in self.sources]
        if lacking or name in self.stages or name in self.sources:
            raise StageError(f"{name} is there already, or its inputs aren't: {lacking}")
        self.stages[name] = Stage(name, make, tuple(inputs), parameters, version)
        return self

    def digest(self, name: str) -> str:
        if name in self.sources:
            if name not in self._sources:
                fs, path = runtime.file_system(self.spark, self.sources[name])
                if not fs.exists(path):
                    raise StageError(f"source {name} isn't there: {self.sources[name]}")
                found, files = fs.listFiles(path, True), []
                while found.hasNext():
                    f = found.next()
                    if not f.getPath().getName().startswith(("_", ".")):
                        files.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
                self._sources[name] = _digest(sorted(files))
            return self._sources[name]
        return _digest(self.identity(name))

    def identity(self, name: str) -> dict:
        s = self.stages[name]
        return {"stage": s.name, "version": s.version, "parameters": s.parameters, "inputs": {i: self.digest(i) for i in s.inputs}}

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}-{self.digest(name)}"

    def _text(self, path: str, text: str | None = None) -> str | None:
        """Write a small file, or read it."""
        fs, where = runtime.file_system(self.spark, path)
        jvm = self.spark.sparkContext._jvm
        if text is not None:
            out = fs.create(where, True)
            out.write(bytearray(text.encode()))
            out.close()
            return text
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        read = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return read

    def done(self, name: str) -> bool:
        """Whether the stage is stored; refused where its folder says that it is something else."""
        said = self._text(f"{self.folder(name)}/_identity.json")
        if said is not None and json.loads(said) != json.loads(json.dumps(self.identity(name), default=str)):
            raise StageError(f"{self.folder(name)} holds another stage")
        return said is not None

    def plan(self) -> list[tuple[str, str, bool]]:
        """(stage, folder, done) of all stages in order, without running any."""
        return [(n, self.folder(n), self.done(n)) for n in self.stages]

    def table(self, name: str) -> DataFrame:
        """The table of a source or a stage; stages that aren't stored yet are made first, with what they need."""
        if name in self.sources:
            return self.spark.read.parquet(self.sources[name])
        target = self.folder(name)
        if self.done(name):
            if name not in self.made and name not in self.reused:
                self.reused.append(name)
            return self.spark.read.parquet(f"{target}/data")
        s = self.stages[name]
        rows = s.make(*(self.table(i) for i in s.inputs), **s.parameters)
        fresh = f"{target}.{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{fresh}/data")
        self._text(f"{fresh}/_identity.json", json.dumps(self.identity(name), default=str))
        fs, where = runtime.file_system(self.spark, fresh)
        _, to = runtime.file_system(self.spark, target)
        if not fs.rename(where, to) or not self.done(name):  # another run may have been faster: then its table is this one
            fs.delete(where, True)
        self.made.append(name)
        return self.spark.read.parquet(f"{target}/data")
