"""A versioned store of notes and vectors in Parquet.

``meta.json`` names the parts of the current snapshot and is replaced atomically, so readers see one
snapshot or the next.  Changes cost what they change: notes and vectors are only ever added, as a new
part; a removed, replaced or renamed note is a row (note_id, gen) that hides that note's rows of
earlier generations.  When there are many parts, the newest that together are no larger than the one before
are merged, so that a row is written again a few times in all, however large the store; ``compact``
writes all live rows anew.

There is one writer at a time: a change holds the file ``lock``, and is refused if another writer has it
or has changed the store since it was opened.  Readers keep the snapshot that they opened.
"""

from __future__ import annotations

import functools
import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import span_rows, strip_query_text
from ..operators import maintenance as m
from ..operators import search as s
from ..operators.embedder import Embedder
from ..operators.highlight import highlight_rows
from .shared import discard

FORMAT, MOST_PARTS = 2, 32
NOTES = T.StructType([T.StructField("note_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("gen", T.LongType())])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("note_id", T.LongType()), T.StructField("start_i", T.LongType()), T.StructField("end_i", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("gen", T.LongType())])
HIDDEN = T.StructType([T.StructField("note_id", T.LongType()), T.StructField("gen", T.LongType())])


class StoreError(Exception):
    pass


class IncompatibleStore(StoreError):
    pass


class InvalidPath(StoreError, ValueError):
    pass


class NotFound(StoreError, KeyError):
    pass


class PathExists(StoreError):
    pass


class DuplicatePath(StoreError, ValueError):
    pass


class OverlappingVectors(StoreError):
    pass


class InvalidVectors(StoreError):
    pass


class MultipleRemove(StoreError):
    pass


class ConcurrentWrite(StoreError):
    """Another writer is at work, or has been since this store was opened: open it again."""


class _Files:
    """Small files on whatever file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames over, which is atomic."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(beside), True)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = next(r for r in rename if r.toString() == "OVERWRITE")
        context.rename(self._path(beside), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def claim(self, name: str) -> bool:
        """Creates the file if it isn't there, in one step; whether it did."""
        if self.fs.getUri().getScheme() == "file":  # that of Hadoop isn't one step there
            path = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        from py4j.protocol import Py4JJavaError

        try:
            self.fs.create(self._path(name), False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True


def change(run: Callable) -> Callable:
    """A method that changes the store, alone: threads of one writer wait for each other, another writer is refused."""

    @functools.wraps(run)
    def alone(self: VectorStore, *args, **kwargs):
        with self._alone:
            if self._busy:  # part of another change
                return run(self, *args, **kwargs)
            if not self._files.claim("lock"):
                raise ConcurrentWrite("another writer has the lock; if it died, unlock()")
            self._busy = True
            try:
                now = json.loads(self._files.read("meta.json"))["snapshot"] if self._files.exists("meta.json") else 0
                if now != self._meta["snapshot"]:
                    raise ConcurrentWrite(f"the store is at snapshot {now}, this one was opened at {self._meta['snapshot']}")
                return run(self, *args, **kwargs)
            finally:
                self._busy = False
                self._files.delete("lock")

    return alone


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, files: _Files, meta: dict):
        self.spark, self.path, self.embedder, self._files, self._meta = spark, path.rstrip("/"), embedder, files, meta
        self._alone, self._busy = threading.RLock(), False

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedder: Embedder) -> VectorStore:
        """Opens or creates a store; one of another format, model, dimension or element type is refused."""
        files = _Files(spark, path)
        want = {"fmt_v": FORMAT, "model": embedder.name, "dim": embedder.dim, "elem_type": "f32"}
        if files.exists("meta.json"):
            meta = json.loads(files.read("meta.json"))
            wrong = [k for k, v in want.items() if meta.get(k) != v]
            if wrong:
                raise IncompatibleStore(", ".join(f"{k} is {meta.get(k)!r}, not {want[k]!r}" for k in wrong))
        else:
            meta = want | {"snapshot": 0, "next_note_id": 1, "next_vec_id": 0, "notes": [], "gone": [], "vectors": [], "hidden": [], "rows": {}, "epochs": {}}
        return cls(spark, path, embedder, files, meta)

    def unlock(self) -> None:
        """Takes away the lock of a writer that died."""
        self._files.delete("lock")

    # tables of the snapshot

    def _read(self, schema: T.StructType, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _live(self, schema: T.StructType, parts: str, hidden: str, among: list[str] | None = None) -> DataFrame:
        rows = self._read(schema, self._meta[parts] if among is None else among)
        if not self._meta[hidden]:
            return rows
        until = self._read(HIDDEN, self._meta[hidden]).groupBy("note_id").agg(F.max("gen").alias("until"))
        return rows.join(until, "note_id", "left").where("until is null or gen >= until").select(*schema.names)

    def notes(self) -> DataFrame:
        return self._live(NOTES, "notes", "gone").drop("gen")

    def vectors(self) -> DataFrame:
        return self._live(VECTORS, "vectors", "hidden").where("vec is not null").drop("gen")

    def count(self) -> int:
        return self.notes().count()

    def get_id(self, path: str) -> int | None:
        row = self.notes().where(F.col("path") == path).first()
        return row and row["note_id"]

    def get_path(self, note_id: int) -> str | None:
        row = self.notes().where(F.col("note_id") == note_id).first()
        return row and row["path"]

    def get_vector(self, vec_id: int) -> list[float] | None:
        row = self.vectors().where(F.col("vec_id") == vec_id).first()
        return row and row["vec"]

    def occupied(self, vec_id: int) -> bool:
        return not self.vectors().where(F.col("vec_id") == vec_id).isEmpty()

    def vecs_for_note(self, note_id: int) -> DataFrame:
        return m.vecs_for_note(self.vectors(), note_id)

    def stats(self) -> dict:
        return {"snapshot": self._meta["snapshot"], "parts": len(self._meta["vectors"]), "notes": self.count(), "vectors": self.vectors().count()}

    # changes

    def _tag(self) -> str:
        return f"snap-{self._meta['snapshot'] + 1:08d}-{uuid.uuid4().hex[:8]}"

    def _write(self, rows: DataFrame, schema: T.StructType, name: str) -> str:
        rows.withColumn("gen", F.lit(self._meta["snapshot"] + 1).cast("long")).select(*schema.names).write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, tag: str, notes: DataFrame | str | None = None, gone: DataFrame | None = None, vectors: DataFrame | str | None = None, hidden: DataFrame | None = None, **meta) -> None:
        """The next snapshot: with the given rows, or parts written already, of each table."""
        new = self._meta | {"snapshot": self._meta["snapshot"] + 1} | meta
        for kind, schema, rows in (("notes", NOTES, notes), ("gone", HIDDEN, gone), ("vectors", VECTORS, vectors), ("hidden", HIDDEN, hidden)):
            if rows is not None:
                new[kind] = [*new[kind], rows if isinstance(rows, str) else self._write(rows, schema, f"{tag}/{kind}")]
        for kind, schema, number, following in (("notes", NOTES, "note_id", "next_note_id"), ("vectors", VECTORS, "vec_id", "next_vec_id")):
            if new[kind] != self._meta[kind]:
                n, top = self._read(schema, new[kind][-1:]).agg(F.count("*"), F.max(number)).first()
                new["rows"] = new["rows"] | {new[kind][-1]: n}
                new[following] = max(new[following], 0 if top is None else top + 1)
        self._replace(new)
        if max(len(new[kind]) for kind in ("notes", "gone", "vectors", "hidden")) > MOST_PARTS:
            self.merge()

    def _replace(self, new: dict) -> None:
        new["rows"] = {name: n for name, n in new["rows"].items() if name in new["notes"] or name in new["vectors"]}
        self._files.replace("meta.json", json.dumps(new))
        self._meta = new

    @change
    def merge(self) -> None:
        """Merges the newest parts of each table: half of those that there may be at least, and on as long as the part before isn't larger than they are together."""
        tag, new = self._tag(), dict(self._meta)
        for kind, schema, hidden in (("notes", NOTES, "gone"), ("vectors", VECTORS, "hidden")):
            parts = new[kind]
            if len(parts) > MOST_PARTS:
                sizes = [new["rows"][p] for p in parts]
                at = max(0, len(parts) - max(2, MOST_PARTS // 2))
                while at and sizes[at - 1] <= sum(sizes[at:]):
                    at -= 1
                name = f"{tag}/{kind}"
                self._live(schema, kind, hidden, parts[at:]).write.parquet(f"{self.path}/{name}")  # with the generations that they have
                new[kind] = [*parts[:at], name]
                new["rows"] = new["rows"] | {name: self._read(schema, [name]).count()}
        for kind in ("gone", "hidden"):
            if len(new[kind]) > MOST_PARTS:
                name = f"{tag}/{kind}"
                self._read(HIDDEN, new[kind]).groupBy("note_id").agg(F.max("gen").alias("gen")).write.parquet(f"{self.path}/{name}")
                new[kind] = [name]
        self._replace(new | {"snapshot": self._meta["snapshot"] + 1})

    @change
    def compact(self) -> None:
        """Writes the live notes and vectors as one part each.  Earlier parts stay for readers that have them open, until ``vacuum``."""
        tag = self._tag()
        notes, vectors = self._write(self.notes(), NOTES, f"{tag}/notes"), self._write(self.vectors(), VECTORS, f"{tag}/vectors")
        rows = {notes: self._read(NOTES, [notes]).count(), vectors: self._read(VECTORS, [vectors]).count()}
        self._replace(self._meta | {"snapshot": self._meta["snapshot"] + 1, "notes": [notes], "gone": [], "vectors": [vectors], "hidden": [], "rows": rows})

    @change
    def vacuum(self) -> None:
        """Deletes the parts that the current snapshot doesn't name."""
        named = {n.split("/")[0] for kind in ("notes", "gone", "vectors", "hidden") for n in self._meta[kind]}
        for status in self._files.fs.listStatus(self._files._path("")):
            name = status.getPath().getName()
            if name.startswith("snap-") and name not in named:
                self._files.delete(name)

    def chunks(self, docs: DataFrame, *keys: str) -> DataFrame:
        """(keys, start_i, end_i, contents): the sentences of two letters or digits at least."""
        return span_rows(docs, F.col("contents"), *keys, least=2, drop=("pos", "type"))

    def embedded(self, docs: DataFrame) -> DataFrame:
        """(path, start_i, end_i, vec): the same with their vectors, null for those that have none."""
        return self.chunks(docs, "path").select("path", "start_i", "end_i", self.embedder.embed(F.col("contents")).alias("vec"))

    @change
    def ingest(self, docs: DataFrame, stream: str | None = None, epoch: int | None = None) -> None:
        """Adds (path, contents) or replaces what a path had; of rows of one path that of the highest ``seq`` counts.

        Empty contents keep the path, without vectors.  A batch of a stream that was taken already is skipped.
        Chunks are numbered before they are embedded, and the vectors go straight to the part that is
        kept: each chunk goes to the embedder once.
        """
        if stream is not None and self._meta["epochs"].get(stream, -1) >= epoch:
            return
        if not docs.where("path is null or path = ''").isEmpty():
            raise InvalidPath("a path is empty")
        if "seq" in docs.columns:
            docs = m.latest(docs.select("path", "contents", "seq"))
        elif not docs.groupBy("path").count().where("count > 1").isEmpty():
            raise DuplicatePath("a path occurs twice and there is no seq")
        tag, known, used = self._tag(), self.notes(), []
        new = self._write(m.new_ids(m.unknown(known, docs), "path", self._meta["next_note_id"], "note_id", used), NOTES, f"{tag}/notes")
        every = known.unionByName(self._read(NOTES, [new]).drop("gen"))
        rows = self.chunks(docs.join(every, "path"), "note_id")
        placed = m.numbered(rows, ["note_id", "start_i", "end_i"], self._meta["next_vec_id"], "vec_id", used)
        added = self._write(placed.withColumn("vec", self.embedder.embed(F.col("contents"))), VECTORS, f"{tag}/vectors")
        replaced = known.join(docs.select("path"), "path", "left_semi").select("note_id")
        epochs = self._meta["epochs"] | ({stream: epoch} if stream is not None else {})
        self._commit(tag, notes=new, vectors=added, hidden=replaced, epochs=epochs)
        for t in used:
            discard(t)

    @change
    def remove(self, path: str) -> None:
        """Drops a path and its vectors together; an unknown path is no error."""
        if not path:
            raise InvalidPath("the path is empty")
        gone = self.notes().where(F.col("path") == path).select("note_id")
        if not gone.isEmpty():
            self._commit(self._tag(), gone=gone, hidden=gone)

    @change
    def rename(self, old: str, new: str) -> None:
        """The id stays; the new path must be free."""
        if not old or not new:
            raise InvalidPath("a path is empty")
        note = self.notes().where(F.col("path") == old)
        if note.isEmpty():
            raise NotFound(old)
        if old == new:
            return
        if self.get_id(new) is not None:
            raise PathExists(new)
        self._commit(self._tag(), notes=m.renamed(note, old, new), gone=note.select("note_id"))

    @change
    def prune(self, existing: DataFrame) -> None:
        """Drops the paths that aren't in ``existing``, with their vectors."""
        gone = self.notes().join(existing.select("path").distinct(), "path", "left_anti").select("note_id")
        self._commit(self._tag(), gone=gone, hidden=gone)

    @change
    def remove_vector(self, vec_id: int) -> None:
        """Drops one vector; one that isn't there is an error."""
        row = self.vectors().where(F.col("vec_id") == vec_id).select("note_id").first()
        if row is None:
            raise MultipleRemove(str(vec_id))
        rest = self.vectors().where((F.col("note_id") == row["note_id"]) & (F.col("vec_id") != vec_id))
        self._commit(self._tag(), vectors=rest, hidden=self.spark.range(1).select(F.lit(row["note_id"]).cast("long").alias("note_id")))

    @change
    def copy_vector(self, vec_id: int) -> int | None:
        """A second row like that one; its id, or None if there is none."""
        row = self.vectors().where(F.col("vec_id") == vec_id)
        if row.isEmpty():
            return None
        new = self._meta["next_vec_id"]
        self._commit(self._tag(), vectors=row.withColumn("vec_id", F.lit(new).cast("long")))
        return new

    def validate(self) -> None:
        rows = self.vectors()
        if not rows.where(F.size("vec") != self.embedder.dim).isEmpty():
            raise InvalidVectors("a vector has another dimension")
        if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
            raise InvalidVectors("an id occurs twice")
        found = m.overlaps(rows).first()
        if found:
            raise OverlappingVectors(f"vectors {found['vec_a']} and {found['vec_b']} of note {found['note_id']}")

    # queries

    def _query(self, query: str, k: int, threshold: float | None, run) -> DataFrame:
        text = strip_query_text(query)
        vec = self.embedder.embed_one(text) if text and k > 0 else None
        if vec is None:
            return self.spark.createDataFrame([], "rank int, path string, start_i long, end_i long, similarity double")
        return run(self.vectors(), self.notes(), s.literal(vec), k, self.embedder.threshold if threshold is None else threshold)

    def search(self, query: str, k: int = 20, threshold: float | None = None) -> DataFrame:
        return self._query(query, k, threshold, s.search)

    def unique_search(self, query: str, k: int = 20, threshold: float | None = None) -> DataFrame:
        return self._query(query, k, threshold, s.unique_search)

    def search_batch(self, queries: DataFrame, k: int = 20, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, path, start_i, end_i, similarity) for a table (query_id, query); as in ``search``, rows without a path go and ranks close up."""
        from ..functions.text import strip_query

        asked = queries.select("query_id", strip_query(F.col("query")).alias("q")).where("q <> ''").select("query_id", self.embedder.embed(F.col("q")).alias("vec"))  # those without a vector are left out of the blocks
        vectors = self.vectors()
        best = s.search_batch(vectors, asked, k, self.embedder.threshold if threshold is None else threshold)
        found = best.join(vectors.select("vec_id", "note_id", "start_i", "end_i"), "vec_id").join(self.notes(), "note_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
        return found.select("query_id", rank.alias("rank"), "path", "start_i", "end_i", "similarity")

    def highlights(self, query: str, text: str, n: int = 16) -> list[tuple[int, int]]:
        vec = self.embedder.embed_one(query) if query and n > 0 else None
        if vec is None:
            return []
        doc = self.spark.createDataFrame([(0, text)], "id int, text string")
        row = highlight_rows(doc, s.literal(vec), self.embedder, "id", "text", n).first()
        return [(h["start_i"], h["end_i"]) for h in row["highlights"]] if row else []

    def ingest_stream(self, stream: DataFrame, checkpoint: str, name: str = "ingest", available_now: bool = True):
        """Takes (path, contents, seq) from a streaming DataFrame batch by batch, the latest row of each path; rows with an empty path are left out."""
        from ..streaming.ingest import start

        return start(self, stream, checkpoint, name, available_now)
