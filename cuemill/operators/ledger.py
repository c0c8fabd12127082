"""A store of replies to model calls in a folder that executors share.

Calls cost money and tasks may run twice, so a reply is kept as soon as it has come, in a file of its own. A task looks here
before it calls; one that runs again, after its executor was lost or in a later run of the program, sends only what has no
reply yet. A request is known by its media item, its batch and a hash of what is asked, so a changed text is asked anew.

Media items are dealt into buckets. When a task leaves a bucket, or has LOOSE replies of it, it packs its replies there into
one compressed file, and the files of their own go only then. So few of these exist at a time, whatever the number of
requests (each takes a block of the disk), and a task reads a bucket's packs once. Replies of the older layout, a folder for
each media item, are still found.

A lost batch is noted under the run in which it was lost. The note is the stop sign of its media item: other tasks of the
run look for it before each call. A later run starts without such notes.

Files are written under another name and then renamed, so that no reader sees half of one. Two attempts of one task that
run at the same time (speculation) may both send a request; either reply may be the one that is read later.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, functions as F

#: (attempt, status, error, texts) of a request, in order.
Rows = list[tuple[int, str, str | None, list[str] | None]]


#: Buckets of media items; replies of a task in files of their own before they are packed.
BUCKETS, LOOSE = 1024, 500
_PACK = ".jsonl.gz"


def _name(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def bucket(media_id: Column) -> Column:
    """The bucket of a media item, as Ledger has it. Requests should come to a task bucket by bucket."""
    return (F.conv(F.substring(F.sha2(media_id, 256), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


class Ledger:
    """uri: the folder, with its file system's scheme, as pyarrow.fs knows it (file, hdfs, s3, gs). run: what parts the
    notes of lost batches from those of other runs."""

    def __init__(self, uri: str, run: str):
        self.uri, self.run = uri.rstrip("/"), run
        self._known: tuple[str, dict[str, Rows | None]] = ("", {})
        self._loose: list[tuple[str, Rows]] = []
        self._open()
        self.old = any(len(f.base_name) == 2 for d in self._list(self.root) if d.base_name.startswith("replies-") for f in self._list(d.path))

    def _open(self) -> None:
        try:
            self.fs, self.root = fs.FileSystem.from_uri(self.uri)
        except Exception as e:
            raise ValueError(f"replies cannot be kept in {self.uri}: {e}") from e

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "run": self.run, "old": self.old}

    def __setstate__(self, state: dict) -> None:
        self.uri, self.run, self.old, self._known, self._loose = state["uri"], state["run"], state["old"], ("", {}), []
        self._open()

    def _item(self, kind: str, media_id: str) -> str:
        name = _name(media_id)
        return f"{self.root}/{kind}/{name[:2]}/{name}"

    @staticmethod
    def _replies(how: str) -> str:
        return f"replies-{_name(how)[:8]}"

    @staticmethod
    def _file(batch_no: int, asked: list[str], how: str) -> str:
        return f"{batch_no}-{_name(json.dumps([how, asked]))}.json"

    def _list(self, folder: str) -> list[fs.FileInfo]:
        return [f for f in self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith(".")]

    def _files(self, folder: str) -> set[str]:
        return {f.base_name for f in self._list(folder)}

    def _bucket(self, media_id: str, how: str) -> str:
        return f"{self.root}/{self._replies(how)}/b{int(_name(media_id)[:8], 16) % BUCKETS:04d}"

    def _bytes(self, path: str) -> bytes:
        with self.fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def _enter(self, folder: str) -> None:
        """Makes folder the bucket at hand: what it holds (None: in a file of its own, not read yet)."""
        if self._known[0] == folder:
            return
        self.flush()
        known: dict[str, Rows | None] = {}
        # Own files are listed first: one that is packed meanwhile is in the second list.
        names, packs = self._files(folder), self._files(folder)
        for name in packs:
            if name.endswith(_PACK):
                for line in gzip.decompress(self._bytes(f"{folder}/{name}")).splitlines():
                    key, rows = json.loads(line)
                    known[key] = [tuple(r) for r in rows]
        for name in names:
            if not name.endswith(_PACK):
                known.setdefault(name, None)
        self._known = folder, known

    def read(self, media_id: str, batch_no: int, asked: list[str], how: str) -> Rows | None:
        """What is kept of a request. A bucket is read once while its requests follow each other."""
        folder, file = self._bucket(media_id, how), self._file(batch_no, asked, how)
        self._enter(folder)
        name = f"{_name(media_id)}-{file}"
        if name in self._known[1]:
            rows = self._known[1][name]
            if rows is None:
                try:
                    rows = [tuple(r) for r in json.loads(self._bytes(f"{folder}/{name}"))]
                except FileNotFoundError:  # packed by another attempt of this task
                    self._known = "", {}
                    return self.read(media_id, batch_no, asked, how)
            return rows
        path = f"{self._item(self._replies(how), media_id)}/{file}"
        if self.old and self.fs.get_file_info(path).type != fs.FileType.NotFound:
            return [tuple(r) for r in json.loads(self._bytes(path))]
        return None

    def write(self, media_id: str, batch_no: int, asked: list[str], how: str, rows: Rows) -> None:
        folder, name = self._bucket(media_id, how), f"{_name(media_id)}-{self._file(batch_no, asked, how)}"
        self._enter(folder)
        self._put(folder, name, rows)
        self._loose.append((name, rows))
        if len(self._loose) >= LOOSE:
            self.flush()

    def flush(self) -> None:
        """Packs what this task has written into the bucket at hand."""
        if len(self._loose) > 1:  # one alone takes no more room than its pack
            folder, loose = self._known[0], self._loose
            self._save(folder, f"{uuid.uuid4().hex}-{len(loose)}{_PACK}", gzip.compress("\n".join(json.dumps(x) for x in loose).encode(), 6))
            for name, rows in loose:
                self.fs.delete_file(f"{folder}/{name}")
                self._known[1][name] = rows
        self._loose = []

    def stop(self, media_id: str, batch_no: int, asked: list[str], how: str, rows: Rows) -> None:
        """Notes a lost batch."""
        self._put(self._item(f"lost-{self.run}", media_id), self._file(batch_no, asked, how), rows)

    def lost(self, media_id: str, batch_no: int, asked: list[str], how: str) -> Rows | None:
        """What is noted of this very batch, if it was lost in this run."""
        path = f"{self._item(f'lost-{self.run}', media_id)}/{self._file(batch_no, asked, how)}"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return [tuple(r) for r in json.loads(f.read())]

    def stopped(self, media_id: str) -> bool:
        return bool(self._files(self._item(f"lost-{self.run}", media_id)))

    def _put(self, folder: str, name: str, rows: Rows) -> None:
        self._save(folder, name, json.dumps(rows).encode())

    def _save(self, folder: str, name: str, content: bytes) -> None:
        self.fs.create_dir(folder, recursive=True)
        half = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(half, compression=None) as f:
            f.write(content)
        self.fs.move(half, f"{folder}/{name}")

    def count(self, how: str) -> int:
        """Replies kept so far, of this run and of earlier ones (also to texts that have changed since). Those that are
        being packed may count twice for a moment."""
        files = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{self._replies(how)}", allow_not_found=True, recursive=True))
        names = [f.base_name for f in files if f.is_file and not f.base_name.startswith(".")]
        return sum(int(n.removesuffix(_PACK).rpartition("-")[2]) if n.endswith(_PACK) else 1 for n in names)
