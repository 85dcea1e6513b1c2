"""Mailboxes as a Spark data source: one partition a mailbox, each read where its task runs.

    spark.dataSource.register(MailboxSource)
    spark.read.format("mailbox").option("host", ...).option("user", ...).option("secret_variable", ...).load()

option("items", "structures") gives the structure of each message as its content, null where the server cannot tell it.
option("folder") reads a folder of folders of .eml files instead of a server, for tests and for mail that is already
on disk. Secrets are taken from the environment of the tasks and never from an option.

spark.readStream of the same format follows mailboxes as they grow: the offset is each mailbox's validity and its highest
uid, and nothing else of a mailbox comes to the driver to stay: while a batch is planned it holds the uids of one mailbox,
8 bytes each, and a task those of its own messages. A mailbox whose validity has changed begins anew.
option("ranges", n) reads a mailbox's share of a batch in up to n tasks, each with a session of its own; 1 without it.
option("per_batch", n) admits at most n messages of a mailbox to a micro-batch, which with the trigger's tick is the pace;
option("position", path) is a file in which the offset of the last planned batch is noted, so that a restarted stream knows
where admission stands. Without it the first batch after a restart admits all.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "mailbox string, uidvalidity long, uid long, content binary"


#: Messages whose structures are asked for at once, messages of the least range of a mailbox.
STRUCTURES_AT_ONCE, RANGE = 50, 500


def in_halves(fetch: Callable[[list], Iterable[tuple]], items: list, size: int) -> Iterator[tuple]:
    """What fetch gives for batches of items, as (item, value). A batch that fails is halved until the item that spoils
    it is alone, which comes with None; a lost connection ends it all, for Spark to try the task again."""
    import imaplib

    work = [items[k : k + size] for k in range(0, len(items), size)][::-1]
    while work:
        batch = work.pop()
        try:
            found = list(fetch(batch))
        except imaplib.IMAP4.abort:
            raise
        except imaplib.IMAP4.error:
            half = len(batch) // 2
            if half:
                work += [batch[half:], batch[:half]]
                continue
            found = [(batch[0], None)]
        yield from found


def in_order(uids: Iterable[int]) -> np.ndarray:
    """uids in order, each once, as numbers of 8 bytes."""
    return np.unique(np.fromiter(uids, np.int64))


class Mailbox(InputPartition):
    """A mailbox, or its messages with above < uid <= upto under one validity."""

    def __init__(self, name: str, epoch: int | None = None, above: int = 0, upto: int | None = None):
        self.name, self.epoch, self.above, self.upto = name, epoch, above, upto

    def holds(self, epoch: int, uid: int) -> bool:
        return self.epoch is None or (epoch == self.epoch and self.above < uid <= self.upto)


class FolderReader(DataSourceReader):
    """Folders of <uid>.eml files; the number in a file "uidvalidity" beside them, 0 without one."""

    def __init__(self, options: dict[str, str]):
        self.root = Path(options["folder"])

    def partitions(self) -> list[Mailbox]:
        return [Mailbox("/".join(parts)) for parts in sorted(self.folders(()))]

    def folders(self, above: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        """The folders below one, by the names on the way to them; messages are passed by."""
        found: list[tuple[str, bool]] = []
        with contextlib.suppress(OSError), os.scandir(self.root.joinpath(*above)) as entries:
            found = [(f.name, f.is_symlink()) for f in entries if f.is_dir()]
        for name, linked in found:
            yield (*above, name)
            if not linked:
                yield from self.folders((*above, name))

    def epoch(self, name: str) -> int:
        mark = self.root / name / "uidvalidity"
        return int(mark.read_text()) if mark.exists() else 0

    def uids(self, name: str, above: int) -> tuple[int, np.ndarray]:
        """The validity, and the uids from `above` on in order."""
        return self.epoch(name), in_order(u for u, _ in self.files(name) if u > above)

    def files(self, name: str) -> Iterator[tuple[int, str]]:
        """The uid of each message and its file's name."""
        with os.scandir(self.root / name) as found:
            for f in found:
                uid, _, kind = f.name.rpartition(".")
                if kind == "eml" and uid.isdigit():
                    yield int(uid), f.name

    def read(self, partition: Mailbox) -> Iterator[tuple]:
        epoch = self.epoch(partition.name)
        files = {u: f for u, f in self.files(partition.name) if partition.holds(epoch, u)}
        for uid in sorted(files):
            yield partition.name, epoch, uid, (self.root / partition.name / files[uid]).read_bytes()


class ServerReader(DataSourceReader):
    """An IMAP server over TLS; every task opens its own read-only session."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def session(self):
        import imaplib

        port = int(self.options.get("port", "993"))
        if self.options.get("security", "tls") == "starttls":
            server = imaplib.IMAP4(self.options["host"], port, timeout=30)
            server.starttls()
        else:
            server = imaplib.IMAP4_SSL(self.options["host"], port, timeout=30)
        server.login(self.options["user"], os.environ[self.options["secret_variable"]])
        return server

    def partitions(self) -> list[Mailbox]:
        server = self.session()
        _, lines = server.list('""', "*")
        server.logout()
        named = [re.match(rb'\((?P<flags>[^)]*)\) (?:"[^"]*"|NIL) (?P<name>.*)', line) for line in lines if line]
        return [Mailbox(m["name"].decode().strip('"')) for m in named if m and b"\\noselect" not in m["flags"].lower()]

    def uids(self, name: str, above: int) -> tuple[int, np.ndarray]:
        """The validity, and the uids from `above` on in order."""
        server = self.session()
        server.select(f'"{name}"', readonly=True)
        epoch = int((server.response("UIDVALIDITY")[1] or [b"0"])[0] or 0)
        _, found = server.uid("SEARCH", f"UID {above + 1}:*")
        server.logout()
        # a range that begins behind the last message holds the last one
        return epoch, in_order(u for u in (int(m[0]) for m in re.finditer(rb"[0-9]+", found[0])) if u > above)

    def read(self, partition: Mailbox) -> Iterator[tuple]:
        server = self.session()
        server.select(f'"{partition.name}"', readonly=True)
        epoch = int((server.response("UIDVALIDITY")[1] or [b"0"])[0] or 0)
        _, found = server.uid("SEARCH", "ALL")
        uids = [u for u in found[0].split() if partition.holds(epoch, int(u))]
        if self.options.get("items") == "structures":
            for uid, structure in in_halves(lambda some: structures(server, some), uids, STRUCTURES_AT_ONCE):
                yield partition.name, epoch, int(uid), structure
            server.logout()
            return
        size = int(self.options.get("batch_size", "20"))
        for k in range(0, len(uids), size):
            _, parts = server.uid("FETCH", b",".join(uids[k : k + size]).decode(), "(UID BODY.PEEK[])")
            for part in parts:
                uid = re.search(rb"UID (\d+)", part[0]) if isinstance(part, tuple) else None
                if uid:
                    yield partition.name, epoch, int(uid[1]), part[1]
        server.logout()


def structures(server, uids: list[bytes]) -> Iterator[tuple]:
    """(uid, structure) of messages; a structure with literals in it comes in several pieces."""
    import imaplib

    status, parts = server.uid("FETCH", b",".join(uids).decode(), "(UID BODYSTRUCTURE)")
    if status != "OK":
        raise imaplib.IMAP4.error(str(parts))
    whole = b"".join(b"".join((p[0], b"\r\n", p[1])) if isinstance(p, tuple) else (p or b"") + b"\n" for p in parts)
    starts = [m.start() for m in re.finditer(rb"(?m)^[0-9]+ \((?=UID |BODYSTRUCTURE )", whole)]
    for start, end in zip(starts, [*starts[1:], len(whole)], strict=True):
        answer = whole[start:end].strip()
        uid, body = re.search(rb"UID ([0-9]+)", answer), answer.find(b"BODYSTRUCTURE ")
        if uid and body >= 0:
            text = answer[body + len(b"BODYSTRUCTURE ") : -1]
            yield uid[1], re.sub(rb" UID [0-9]+$", b"", text)


class MailboxStream(DataSourceStreamReader):
    """Follows what a reader of mailboxes sees; an offset maps a mailbox to [validity, highest uid]."""

    def __init__(self, reader: FolderReader | ServerReader, per_batch: int | None, position: str | None, ranges: int = 1):
        self.reader, self.per_batch, self.note, self.ranges = reader, per_batch, position, ranges
        self.at: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {}
        return {}

    def noted(self) -> dict:
        from ..sources.stores import system_of

        if self.at is None and self.note:
            system, name = system_of(self.note)
            if system.get_file_info(name).is_file:
                with system.open_input_file(name) as file:
                    self.at = json.loads(file.read())
        return self.at or {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Of each mailbox the uid up to which the next batch goes; mailboxes that are gone leave the offset."""
        at, admits = self.noted(), self.per_batch if self.at is not None else None
        found = {}
        for box in self.reader.partitions():
            known, above = at.get(box.name, [None, 0])
            epoch, uids = self.reader.uids(box.name, above)
            if epoch != known and above:
                epoch, uids = self.reader.uids(box.name, 0)
            above = above if epoch == known else 0
            found[box.name] = [epoch, int(uids[:admits][-1]) if len(uids) else above]
        return found

    def partitions(self, start: dict, end: dict) -> list[Mailbox]:
        from ..sources.stores import write_whole

        self.at = end
        if self.note:
            write_whole(self.note, [json.dumps(end).encode()])
        found = []
        for name, (epoch, upto) in sorted(end.items()):
            known, above = start.get(name, [epoch, 0])
            above = above if known == epoch else 0
            if upto > above:
                found += [Mailbox(name, epoch, *cut) for cut in self.cuts(name, epoch, above, upto)]
        return found

    def cuts(self, name: str, epoch: int, above: int, upto: int) -> list[tuple[int, int]]:
        """above < uid <= upto in ranges of about as many messages each, of RANGE at least."""
        if self.ranges == 1:
            return [(above, upto)]
        now, uids = self.reader.uids(name, above)
        uids = uids[: np.searchsorted(uids, upto, "right")] if now == epoch else uids[:0]
        size = max(RANGE, -(-len(uids) // self.ranges))
        bounds = [above, *uids[size - 1 : -1 : size].tolist(), upto]
        return list(zip(bounds, bounds[1:], strict=False))

    def read(self, partition: Mailbox) -> Iterator[tuple]:
        """A mailbox whose validity has changed since the batch was planned gives nothing; the next batch begins it anew."""
        return self.reader.read(partition)


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options) if "folder" in self.options else ServerReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        n = self.options.get("per_batch")
        return MailboxStream(self.reader(schema), int(n) if n else None, self.options.get("position"), int(self.options.get("ranges", "1")))
