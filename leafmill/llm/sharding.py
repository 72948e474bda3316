"""Shards by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. A shard's tier is the power of `fan` its bytes have reached; `compact` merges runs of shards of one tier into files of up to target size: as soon as a run fills half of it or more, or fan of them make a shard of the next tier. Each merge is one task that streams row groups from its shards into one new file: no shuffle, and memory of one row group. Tasks write to names of their own and only what they report is committed, so a lost or repeated task changes nothing.

What exists is what the newest manifest lists. A manifest names list files of up to LIST shards each; a commit writes the lists that change and manifests/vN.json in one atomic step that fails if another writer was first, so its cost follows what changed, not all that exists. Whoever loses reads the newer version and commits on top of it: arrivals always fit, and of merges those whose inputs are still there.

Shards that a manifest no longer lists stay until `vacuum`. A writer holds a lease from before its first file until its commit, and `vacuum` looks at files first, then leases, then the manifest; so a file is either listed, or its writer's lease was seen, or nobody will ever list it. A lease counts for LEASE seconds, in case its writer was lost; files younger than the age asked for stay in any case, for readers of older versions.

Only shard counts, names and sizes reach the driver. Nulls, empty and long texts, repeated rows, rows with one id and columns of any name are stored as they are, in no order that matters; an empty table appends shards without rows, or none.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import filesystem, shared_dir, write_once

TARGET = 128 << 20
FAN = 4
SMALLEST = 1 << 20
#: Rows of a batch while merging.
ROWS = 4096
#: Shards a list file names.
LIST = 10_000
#: Seconds for which a lease counts.
LEASE = 7 * 86400


class Conflict(Exception):
    """Another writer has committed this version."""


def tier(size: int, fan: int = FAN, smallest: int = SMALLEST) -> int:
    t = 0
    while size >= smallest * fan ** (t + 1):
        t += 1
    return t


def plan(shards: list[dict], target: int = TARGET, fan: int = FAN) -> list[list[dict]]:
    """Groups of two shards or more to merge: of one tier, in order of arrival, none above the target; groups short of half of it need fan shards. Shards of half the target or more stay."""
    tiers: dict[int, list[dict]] = {}
    for s in sorted(shards, key=lambda s: s["seq"]):
        if 2 * s["bytes"] < target:
            tiers.setdefault(tier(s["bytes"], fan), []).append(s)
    out: list[list[dict]] = []
    for _, own in sorted(tiers.items()):
        groups: list[list[dict]] = [[]]
        size = 0
        for s in own:
            if size + s["bytes"] > target:
                groups.append([])
                size = 0
            groups[-1].append(s)
            size += s["bytes"]
        out += [g for g in groups if len(g) > 1 and (len(g) >= fan or 2 * sum(x["bytes"] for x in g) >= target)]
    return out


class ShardSet:
    """A versioned set of shards under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri
        self.fs, self.path = filesystem(uri)
        for name in ("data", "manifests", "leases"):
            self.fs.create_dir(f"{self.path}/{name}", recursive=True)

    def versions(self) -> list[int]:
        from pyarrow import fs

        names = [x.base_name for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _json(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _put(self, name: str, value: dict) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}") as f:
            f.write(json.dumps(value).encode())

    def manifest(self, version: int | None = None) -> dict:
        """version, next, shards, and lists: which list file names which shards."""
        have = self.versions()
        if not have:
            return {"version": 0, "next": 0, "shards": [], "lists": {}}
        found = self._json(f"manifests/v{have[-1] if version is None else version:08d}.json")
        lists = {name: self._json(name)["shards"] for name in found["lists"]}
        return {"version": found["version"], "next": found["next"], "shards": [s for own in lists.values() for s in own], "lists": lists}

    def _lists(self, base: dict, shards: list[dict]) -> list[str]:
        """The list files of a version with these shards: those of base that stay as they are, and new ones. Lists that are far from full are written together once they are many."""
        now = {s["path"] for s in shards}
        kept = {name: own for name, own in base.get("lists", {}).items() if all(s["path"] in now for s in own)}
        small = [name for name, own in kept.items() if 2 * len(own) < LIST]
        if len(small) > 32:
            kept = {name: own for name, own in kept.items() if name not in small}
        listed = {s["path"] for own in kept.values() for s in own}
        rest, made = [s for s in shards if s["path"] not in listed], list(kept)
        for i in range(0, len(rest), LIST):
            made.append(f"manifests/list-{uuid.uuid4().hex}.json")
            self._put(made[-1], {"shards": rest[i : i + LIST]})
        return made

    def commit(self, base: dict, shards: list[dict], following: int) -> dict:
        """Makes shards the version after base, or raises Conflict."""
        new = {"version": base["version"] + 1, "next": following, "lists": self._lists(base, shards)}
        part, name = f"manifests/_{uuid.uuid4().hex}.part", f"manifests/v{new['version']:08d}.json"
        self._put(part, new)
        part, name = f"{self.path}/{part}", f"{self.path}/{name}"
        try:
            if self.uri.startswith(("file:", "/")):
                os.link(part, name)  # fails if the name exists
                os.remove(part)
            else:
                jvm = self.spark._jvm
                at = lambda p: jvm.org.apache.hadoop.fs.Path(self.uri + p[len(self.path) :])
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(part).toUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(at(part), at(name), none)
        except Exception as error:
            if new["version"] in self.versions():
                raise Conflict(f"version {new['version']} exists") from error
            raise
        return self.manifest(new["version"])

    def lease(self, name: str) -> str:
        """Marks data/name as being written; returns the lease's file."""
        self._put(f"leases/{name}", {"since": time.time()})
        return f"{self.path}/leases/{name}"

    def put(self, rows: DataFrame) -> list[dict]:
        """Writes one shard for each task's rows, under a lease; `arrive` makes them part of the set."""
        from pyarrow import fs

        name = f"arrival-{uuid.uuid4().hex}"
        lease = self.lease(name)
        rows.write.parquet(f"{self.uri}/data/{name}")
        found = sorted((x.base_name, x.size) for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/data/{name}")) if x.base_name.endswith(".parquet"))
        return [{"path": f"data/{name}/{n}", "bytes": size, "lease": lease} for n, size in found] or [{"path": None, "bytes": 0, "lease": lease}]

    def arrive(self, written: list[dict], last: bool = True) -> dict:
        """Commits shards that `put` wrote; with the last of them the lease ends."""
        while True:
            base = self.manifest()
            new = [{"path": s["path"], "bytes": s["bytes"], "seq": base["next"] + i} for i, s in enumerate(written) if s["path"]]
            try:
                made = self.commit(base, base["shards"] + new, base["next"] + len(new))
                break
            except Conflict:
                continue  # appends never clash: try on top of the newer version
        if last:
            for lease in {s["lease"] for s in written}:
                self.fs.delete_file(lease)
        return made

    def append(self, rows: DataFrame) -> dict:
        """One shard for each task's rows."""
        return self.arrive(self.put(rows))

    def _merged(self, groups: list[list[dict]], name: str) -> dict[int, dict]:
        """Each group as one new file in data/name: path and bytes by the group's number."""
        path, uri = self.path, self.uri
        jobs = [(i, [s["path"] for s in g]) for i, g in enumerate(groups)]

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow.parquet as pq

            system, _ = filesystem(uri)
            for x in batches:
                for i, files in zip(x["i"].tolist(), x["files"], strict=True):

                    def fill(out, files=files) -> None:
                        writer = None
                        for f in files:
                            with system.open_input_file(f"{path}/{f}") as source:
                                own = pq.ParquetFile(source)
                                writer = writer or pq.ParquetWriter(out, own.schema_arrow, compression="snappy")
                                for batch in own.iter_batches(ROWS):
                                    writer.write_batch(batch.cast(writer.schema), row_group_size=16 * ROWS)
                        writer.close()

                    made = write_once(f"{uri}/data/{name}", "shard", fill)
                    yield pd.DataFrame({"i": [i], "path": [f"data/{name}/{made}"], "bytes": [system.get_file_info(f"{path}/data/{name}/{made}").size]})

        tasks = self.spark.createDataFrame(jobs, "i int, files array<string>").repartition(len(jobs), "i")
        return {r["i"]: r.asDict() for r in tasks.mapInPandas(merge, "i int, path string, bytes bigint").collect()}  # a row a merge

    def compact(self, target: int = TARGET, fan: int = FAN) -> int:
        """Merges until nothing is left to merge; returns how many shards were merged. If another writer was first, the merges whose inputs are all still listed go on top of its version."""
        total = 0
        while groups := plan((base := self.manifest())["shards"], target, fan):
            name = f"merged-{uuid.uuid4().hex}"
            lease = self.lease(name)
            made = self._merged(groups, name)
            while True:
                now = {s["path"] for s in base["shards"]}
                good = {i: g for i, g in enumerate(groups) if all(s["path"] in now for s in g)}
                gone = {s["path"] for g in good.values() for s in g}
                if not good:
                    break
                merged = [{"path": made[i]["path"], "bytes": made[i]["bytes"], "seq": g[0]["seq"]} for i, g in good.items()]
                try:
                    self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + merged, base["next"])
                    break
                except Conflict:
                    base = self.manifest()
            self.fs.delete_file(lease)
            total += len(gone)
        return total

    def vacuum(self, age: float = 0.0) -> int:
        """Deletes files that are older than `age` seconds, that no lease covers and that the newest manifest does not list. Choose an age above the time that readers of older versions take. Returns how many went."""
        from pyarrow import fs

        files = [x for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/data", recursive=True)) if x.is_file]
        leases = self.fs.get_file_info(fs.FileSelector(f"{self.path}/leases"))
        now = time.time()
        held = {x.base_name for x in leases if now - x.mtime.timestamp() < LEASE}
        kept = {s["path"] for s in self.manifest()["shards"]}
        gone = [x.path for x in files if now - x.mtime.timestamp() >= age and (p := os.path.relpath(x.path, self.path)) not in kept and p.split("/")[1] not in held]
        for p in gone:
            self.fs.delete_file(p)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        shards = [f"{self.uri}/{s['path']}" for s in self.manifest(version)["shards"]]
        return self.spark.read.parquet(*shards)


#: Commits over which `report` spreads what it appends.
ARRIVALS = 3


def report(docs: DataFrame, target: int = TARGET, fan: int = FAN) -> DataFrame:
    """Appends docs as shards that arrive in several commits, compacts after each, so that merged shards meet later arrivals, and reads the newest version back: figures and digests of each row."""
    shards = ShardSet(docs.sparkSession, shared_dir(docs.sparkSession, "shards"))
    written = shards.put(docs)
    step = -(-len(written) // ARRIVALS)
    for i in range(0, len(written), step):
        shards.arrive(written[i : i + step], last=i + step >= len(written))
        shards.compact(target, fan)
        shards.vacuum()
    back = shards.read() if shards.manifest()["shards"] else docs.limit(0)
    return back.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS text_bytes, sha256(text) AS text_sha256 FROM documents"
