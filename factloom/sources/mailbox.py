"""Mailboxes as a streaming source whose offsets are message numbers, and their messages as parsed mail.

``spark.readStream.format("mailboxes")`` after ``register(spark)``. A batch is
bounded by ``most`` messages of each mailbox; executors fetch them, a range of
``each`` messages to a task. The first sight of a mailbox, also of one added
later, records its high-water mark and takes nothing. Numbers only go up: a
batch that is run again fetches the same numbers, and a restarted query goes on
after its last batch.

A mailbox that cannot be reached keeps its mark and the others go on. A message
that is refused (too large, or by the ``gate``) stops its mailbox's pass before
it, and is looked at again in the next pass.

Marks of the last planned batch are kept in the file ``marks``, which the driver
writes: Spark does not tell a source where it is when it asks for the newest
offset, and a mailbox out of reach must not lose its place after a restart.
"""

from __future__ import annotations

import imaplib
import json
import os
from collections.abc import Iterator, Sequence
from email import message_from_bytes, policy
from email.message import EmailMessage
from email.utils import getaddresses, parsedate_to_datetime
from importlib import import_module
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "connector string, mailbox string, uid long, raw binary"


class Mailbox(Protocol):
    """What a mailbox can say; made from a connector's fields."""

    def next_uid(self) -> int: ...
    def uids(self, after: int, most: int) -> list[int]:
        """The first numbers after one, ascending."""
        ...

    def sizes(self, uids: list[int]) -> dict[int, int]: ...
    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]: ...
    def close(self) -> None: ...


class FolderMailbox:
    """A folder of ``<uid>.eml`` files, host/user/mailbox."""

    def __init__(self, connector: dict) -> None:
        self.path = os.path.join(connector["host"], connector["user"], connector.get("mailbox") or "INBOX")
        if not os.path.isdir(self.path):
            raise ConnectionError(f"no folder {self.path}")

    def _all(self) -> list[int]:
        return sorted(int(n[:-4]) for n in os.listdir(self.path) if n.endswith(".eml") and n[:-4].isdigit())

    def next_uid(self) -> int:
        return max(self._all(), default=0) + 1

    def uids(self, after: int, most: int) -> list[int]:
        return [u for u in self._all() if u > after][:most]

    def sizes(self, uids: list[int]) -> dict[int, int]:
        return {u: os.path.getsize(os.path.join(self.path, f"{u}.eml")) for u in uids}

    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]:
        for u in uids:
            with open(os.path.join(self.path, f"{u}.eml"), "rb") as f:
                yield u, f.read()

    def close(self) -> None:
        pass


class ImapMailbox:
    """A mailbox on an IMAP server, opened for reading only."""

    def __init__(self, connector: dict) -> None:
        secure = connector.get("secure", True)
        port = int(connector.get("port") or (imaplib.IMAP4_SSL_PORT if secure else imaplib.IMAP4_PORT))
        self.server = (imaplib.IMAP4_SSL if secure else imaplib.IMAP4)(connector["host"], port, timeout=30)
        self.server.login(connector["user"], connector["password"])
        self.server.select(f'"{connector.get("mailbox") or "INBOX"}"', readonly=True)

    def next_uid(self) -> int:
        _, said = self.server.response("UIDNEXT")
        return int(said[0]) if said and said[0] else max(self.uids(0, 1 << 62), default=0) + 1

    def uids(self, after: int, most: int) -> list[int]:
        # "n:*" gives the last message even where none is past n
        _, said = self.server.uid("SEARCH", f"UID {after + 1}:*")
        return sorted(u for u in map(int, (said[0] or b"").split()) if u > after)[:most]

    def _parts(self, uids: list[int], what: str) -> Iterator[tuple[bytes, bytes]]:
        if uids:
            _, said = self.server.uid("FETCH", ",".join(map(str, uids)), what)
            for part in said:
                yield part if isinstance(part, tuple) else (part or b"", b"")

    @staticmethod
    def _number(line: bytes, name: bytes) -> int | None:
        words = line.replace(b"(", b" ").replace(b")", b" ").split()
        return int(words[words.index(name) + 1]) if name in words else None

    def sizes(self, uids: list[int]) -> dict[int, int]:
        return {u: self._number(line, b"RFC822.SIZE") or 0 for line, _ in self._parts(uids, "(UID RFC822.SIZE)") if (u := self._number(line, b"UID")) is not None}

    def fetch(self, uids: list[int]) -> Iterator[tuple[int, bytes]]:
        for u in uids:  # one at a time: a task holds one message
            for line, raw in self._parts([u], "(UID BODY.PEEK[])"):
                if raw and self._number(line, b"UID") == u:
                    yield u, raw

    def close(self) -> None:
        self.server.logout()


def _named(path: str) -> Any:
    """What ``module:name`` is."""
    module, name = path.split(":")
    return getattr(import_module(module), name)


def _connectors(options: dict) -> dict[str, dict]:
    """Connectors by id, from JSON text or, if that is a path, from the file as it is now; ids default to user@host/mailbox."""
    said = options["connectors"]
    if not said.lstrip().startswith(("[", "{")):
        with open(said, encoding="utf-8") as f:
            said = f.read()
    read = json.loads(said)
    out: dict[str, dict] = {}
    for c in read["connectors"] if isinstance(read, dict) else read:
        key = c.get("id") or f"{c['user']}@{c['host']}/{c.get('mailbox') or 'INBOX'}"
        if key in out:
            raise ValueError(f"two connectors are named {key}")
        out[key] = c
    return out


class MailboxReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.open = _named(options.get("client", f"{__name__}:ImapMailbox"))
        self.gate = _named(options["gate"]) if options.get("gate") else None
        self.most, self.each = int(options.get("most", 1000)), int(options.get("each", 50))
        self.largest = int(options.get("largest", 25 << 20))

    def _marks(self) -> dict[str, int]:
        try:
            with open(self.options["marks"], encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _keep(self, marks: dict[str, int]) -> None:
        path = self.options["marks"]
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(marks, f)
        os.replace(f"{path}.new", path)

    def _accepted(self, box: Mailbox, connector: str, after: int) -> int:
        """The last number of this pass: before the first message that is refused."""
        new = box.uids(after, self.most)
        sizes = box.sizes(new)
        for u in new:
            if sizes.get(u, 0) > self.largest or (self.gate and not self.gate(connector, u, box)):
                break
            after = u
        return after

    def _newest(self, marks: dict[str, int]) -> dict[str, int]:
        out = dict(marks)
        for key, connector in _connectors(self.options).items():
            try:
                box = self.open(connector)
                try:
                    out[key] = self._accepted(box, key, marks[key]) if key in marks else max(0, box.next_uid() - 1)
                finally:
                    box.close()
            except (OSError, imaplib.IMAP4.error):
                continue  # out of reach: its mark stays, if it has one
        return out

    def initialOffset(self) -> dict:
        marks = self._newest({})
        self._keep(marks)
        return marks

    def latestOffset(self) -> dict:
        return self._newest(self._marks())

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._keep({k: max(v, self._marks().get(k, 0)) for k, v in end.items()})
        known, out = _connectors(self.options), []
        for key, last in end.items():
            if key in start and key in known and last > start[key]:
                box = self.open(known[key])
                uids = [u for u in box.uids(start[key], last - start[key]) if u <= last]
                box.close()
                out += [InputPartition((key, tuple(uids[i : i + self.each]))) for i in range(0, len(uids), self.each)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        key, uids = partition.value
        connector = _connectors(self.options)[key]
        box = self.open(connector)
        try:
            for uid, raw in box.fetch(list(uids)):
                yield key, connector.get("mailbox") or "INBOX", uid, raw
        finally:
            box.close()

    def commit(self, end: dict) -> None:
        pass


class Mailboxes(DataSource):
    """Options: connectors (JSON, or a file of it that is read anew in each pass), marks (a file), client and gate
    (``module:name``), most, each, largest."""

    @classmethod
    def name(cls) -> str:
        return "mailboxes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return MailboxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mailboxes)


def mail_stream(spark: SparkSession, connectors: str, marks: str, **options: object) -> DataFrame:
    """The stream of (connector, mailbox, uid, raw)."""
    register(spark)
    return spark.readStream.format("mailboxes").options(connectors=connectors, marks=marks, **{k: str(v) for k, v in options.items()}).load()


PARSED = "message_id string, from_addr string, to_addrs array<string>, subject string, text string, html string, date timestamp, authentication_results string, attachments array<struct<filename string, media string, content binary>>"


def _text(part: EmailMessage | None) -> str | None:
    if part is None:
        return None
    try:
        return part.get_content()
    except (LookupError, UnicodeError):  # a charset that nobody knows
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def parse(raw: bytes) -> tuple:
    """A message's fields; what it does not say is null. Addresses are those of From, To, Cc and Delivered-To, lower-cased."""
    m = message_from_bytes(raw, policy=policy.default)

    def header(name: str) -> str | None:
        try:
            said = m.get(name)
        except (ValueError, IndexError, AttributeError):  # headers that cannot be read
            return None
        return None if said is None else str(said).strip()

    def addresses(*names: str) -> list[str]:
        said = [str(x) for n in names for x in (m.get_all(n) or [])]
        return list(dict.fromkeys(a.strip().lower() for _, a in getaddresses(said) if a.strip()))

    try:
        date = parsedate_to_datetime(header("date") or "")
        date = pd.Timestamp(date).tz_localize("UTC") if date.tzinfo is None else pd.Timestamp(date).tz_convert("UTC")
    except (ValueError, TypeError, OverflowError):
        date = None
    files = []
    for part in m.walk():
        if not part.is_multipart() and (part.get_content_disposition() == "attachment" or part.get_filename()):
            files.append({"filename": part.get_filename(), "media": part.get_content_type(), "content": part.get_payload(decode=True) or b""})
    return header("message-id"), next(iter(addresses("from")), None), addresses("to", "cc", "delivered-to"), header("subject"), _text(m.get_body(("plain",))), _text(m.get_body(("html",))), date, header("authentication-results"), files


def parsed(raw: Column | str) -> Column:
    """A struct of PARSED for each raw message; null where there is none."""

    @F.pandas_udf(PARSED)
    def fields(raw: pd.Series) -> pd.DataFrame:
        names = ["message_id", "from_addr", "to_addrs", "subject", "text", "html", "date", "authentication_results", "attachments"]
        out = pd.DataFrame([parse(bytes(x)) if x is not None else (None,) * len(names) for x in raw], columns=names)
        out["date"] = pd.to_datetime(out["date"], utc=True).dt.tz_localize(None).astype("datetime64[ns]")
        return out

    return fields(raw)


def parsed_mail(messages: DataFrame) -> DataFrame:
    """connector, uid and the fields of each message (connector, uid, raw)."""
    return messages.withColumn("mail", parsed("raw")).select("connector", "uid", "mail.*")
