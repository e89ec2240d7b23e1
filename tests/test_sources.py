"""The mailbox source, MIME, and the upsert writer."""

import base64
import json
import sqlite3
from datetime import datetime, timezone
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from factloom.sources import mailbox, upsert


def mail(path, uid, text="hello", size=0):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{uid}.eml").write_bytes(f"Message-ID: <{uid}@x>\r\nFrom: A <a@x.org>\r\nTo: b@x.org\r\nSubject: s\r\n\r\n{text}{'x' * size}\r\n".encode())


class Boxes:
    """A stream over folders, drained into a table."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options = spark, tmp_path, options
        self.boxes = {}

    def box(self, user):
        path = self.path / "host" / user / "INBOX"
        path.mkdir(parents=True, exist_ok=True)
        self.boxes[user] = path
        return path

    def connect(self, *users):
        (self.path / "connectors.json").write_text(json.dumps({"connectors": [{"id": u, "host": str(self.path / "host"), "user": u} for u in users]}))

    def drain(self):
        stream = mailbox.mail_stream(self.spark, str(self.path / "connectors.json"), str(self.path / "marks"), client="factloom.sources.mailbox:FolderMailbox", **self.options)
        q = stream.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["connector"], r["uid"]) for r in self.spark.read.parquet(str(self.path / "out")).collect())


def test_mailboxes_go_on_where_they_were(spark, tmp_path):
    b = Boxes(spark, tmp_path, most=3, each=2)
    one = b.box("one")
    for uid in range(1, 6):
        mail(one, uid)
    b.connect("one")
    assert b.drain() == []  # first sight: the mark, and nothing of what was there
    for uid in (6, 7, 9, 10, 12):
        mail(one, uid)
    assert b.drain() == [("one", u) for u in (6, 7, 9, 10, 12)]
    mail(one, 13)
    two = b.box("two")
    mail(two, 4)
    b.connect("one", "two")
    assert b.drain() == [("one", u) for u in (6, 7, 9, 10, 12, 13)]
    mail(two, 5)
    assert ("two", 5) in b.drain() and ("two", 4) not in b.drain()


def test_one_mailbox_out_of_reach_keeps_its_place(spark, tmp_path):
    b = Boxes(spark, tmp_path)
    one, two = b.box("one"), b.box("two")
    mail(one, 1)
    mail(two, 1)
    b.connect("one", "two")
    b.drain()
    mail(one, 2)
    mail(two, 2)
    two.rename(two.with_name("away"))
    assert b.drain() == [("one", 2)]
    mail(one, 3)
    assert b.drain() == [("one", 2), ("one", 3)]
    two.with_name("away").rename(two)
    assert b.drain() == [("one", 2), ("one", 3), ("two", 2)]


def test_a_refused_message_stops_the_pass(spark, tmp_path):
    b = Boxes(spark, tmp_path, largest=1000)
    one, two = b.box("one"), b.box("two")
    b.connect("one", "two")
    b.drain()
    for box in (one, two):
        mail(box, 1)
    mail(one, 2, size=5000)
    mail(one, 3)
    mail(two, 2)
    assert b.drain() == [("one", 1), ("two", 1), ("two", 2)]
    mail(one, 2)  # mended
    assert b.drain() == [("one", 1), ("one", 2), ("one", 3), ("two", 1), ("two", 2)]


def test_connectors_have_different_names():
    two = json.dumps([{"id": "a", "host": "h", "user": "u"}] * 2)
    with pytest.raises(ValueError):
        mailbox._connectors({"connectors": two})
    assert list(mailbox._connectors({"connectors": json.dumps([{"host": "h", "user": "u"}])})) == ["u@h/INBOX"]


class FakeImap:
    """What a server says, for two messages."""

    def __init__(self, host, port, timeout):
        self.calls = []

    def login(self, user, password):
        self.calls.append(("login", user))

    def select(self, box, readonly):
        assert readonly

    def response(self, what):
        return "OK", [b"8"]

    def uid(self, command, *args):
        if command == "SEARCH":
            return "OK", [b"5 7"]
        if "SIZE" in args[1]:
            return "OK", [b"1 (UID 5 RFC822.SIZE 11)", b"2 (UID 7 RFC822.SIZE 22)"]
        return "OK", [(f"1 (UID {args[0]} BODY[] {{4}}".encode(), b"raw" + args[0].encode()), b")"]

    def logout(self):
        pass


def test_imap(monkeypatch):
    monkeypatch.setattr(mailbox.imaplib, "IMAP4_SSL", FakeImap)
    box = mailbox.ImapMailbox({"host": "h", "user": "u", "password": "p"})
    assert box.next_uid() == 8 and box.uids(5, 10) == [7] and box.uids(7, 10) == []
    assert box.sizes([5, 7]) == {5: 11, 7: 22}
    assert list(box.fetch([5, 7])) == [(5, b"raw5"), (7, b"raw7")]


def test_mime(spark):
    m = EmailMessage()
    m["Message-ID"], m["From"], m["To"], m["Cc"], m["Subject"] = "<1@x>", "Ann <Ann@X.org>", "b@x.org, C <c@x.org>", "b@x.org", "Grüße"
    m["Date"], m["Authentication-Results"] = "Mon, 01 Jan 2024 10:00:00 +0100", "mx; dmarc=fail"
    m.set_content("plain é")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"\x00\x01", maintype="application", subtype="pdf", filename="a.pdf")
    odd = b"From: nobody\r\nContent-Type: text/plain; charset=unheard-of\r\nDate: never\r\n\r\nbody \xff"
    rows = spark.createDataFrame([("c", 1, m.as_bytes()), ("c", 2, odd), ("c", 3, b""), ("c", 4, None)], "connector string, uid long, raw binary")
    got = {r["uid"]: r for r in mailbox.parsed_mail(rows).withColumn("date", F.unix_timestamp("date")).collect()}
    r = got[1]
    assert (r["message_id"], r["from_addr"], r["to_addrs"], r["subject"]) == ("<1@x>", "ann@x.org", ["b@x.org", "c@x.org"], "Grüße")
    assert r["text"].strip() == "plain é" and r["html"].strip() == "<p>html</p>" and r["date"] == int(datetime(2024, 1, 1, 9, tzinfo=timezone.utc).timestamp())
    assert "dmarc=fail" in r["authentication_results"] and [(a["filename"], a["media"], bytes(a["content"])) for a in r["attachments"]] == [("a.pdf", "application/pdf", b"\x00\x01")]
    assert got[2]["text"].startswith("body") and got[2]["date"] is None
    assert got[3]["from_addr"] is None and got[4]["message_id"] is None and got[4]["attachments"] is None


def tables(path):
    with sqlite3.connect(path) as c:
        return {t for (t,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def stored(path, table):
    with sqlite3.connect(path) as c:
        c.row_factory = sqlite3.Row
        return {r["dm_id"]: {k: r[k] for k in r.keys() if k not in ("dm_id", "dm_synced_at")} for r in c.execute(f"SELECT * FROM {table}")}


OPTIONS = {"connect": "factloom.sources.upsert:sqlite", "placeholder": "?"}


def test_upsert_updates_and_adds_columns(spark, tmp_path):
    db = str(tmp_path / "db")
    first = spark.createDataFrame([(str(i), float(i), None) for i in range(50)], "dm_id string, amount double, note string").repartition(4)
    upsert.upsert(first, "My Table", dsn=db, **OPTIONS)
    upsert.upsert(first, "My Table", dsn=db, **OPTIONS)
    assert len(stored(db, "my_table")) == 50
    upsert.upsert(spark.createDataFrame([("7", 70.5, True), ("99", 1.0, False), ("99", 2.0, True)], "dm_id string, amount double, paid boolean").coalesce(1), "My Table", dsn=db, **OPTIONS)
    got = stored(db, "my_table")
    assert got["7"] == {"amount": 70.5, "note": None, "paid": 1} and got["99"]["amount"] == 2.0 and got["8"]["amount"] == 8.0
    assert tables(db) == {"my_table", upsert.JOBS, upsert.REGISTER, upsert.BATCHES}


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    db = str(tmp_path / "db")
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") < 37, F.col("id").cast("string")).alias("dm_id"), F.col("id").alias("n"))  # some without an id
    with pytest.raises(Exception, match="dm_id"):
        upsert.upsert(rows, "t", dsn=db, **OPTIONS)
    assert tables(db) == {upsert.JOBS, upsert.REGISTER, upsert.BATCHES}
    with sqlite3.connect(db) as c:
        assert c.execute(f"SELECT count(*) FROM {upsert.REGISTER}").fetchone() == (0,)


def test_a_lost_task_is_not_merged(tmp_path):
    from pyspark.sql.types import StructType

    db = str(tmp_path / "db")
    w = upsert.UpsertWriter({"table": "t", "dsn": db, **OPTIONS}, StructType().add("dm_id", "string").add("n", "long"))
    w.prepare()

    class Task:
        def partitionId(self):
            return 0

    import factloom.sources.upsert as module

    class Context:
        get = staticmethod(Task)

    kept, module.TaskContext = module.TaskContext, Context
    try:
        from pyspark.sql import Row

        w.write(iter([Row(dm_id="lost", n=1)]))
        counted = w.write(iter([Row(dm_id="kept", n=2)]))
    finally:
        module.TaskContext = kept
    w.commit([counted, None])
    assert stored(db, "t") == {"kept": {"n": 2}} and tables(db) == {"t", upsert.JOBS, upsert.REGISTER, upsert.BATCHES}


def test_a_batch_that_comes_again_is_dropped(spark, tmp_path):
    from pyspark.sql.types import StructType

    db = str(tmp_path / "db")
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1)], "dm_id string, n long").coalesce(1).write.json(str(source))
    upsert.register(spark)

    def drain(checkpoint):
        stream = spark.readStream.schema("dm_id string, n long").json(str(source))
        stream.writeStream.format("upsert").options(table="t", dsn=db, query="q", **OPTIONS).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    drain("cp1")
    with sqlite3.connect(db) as c:
        c.execute("UPDATE t SET n = 5")
    drain("cp2")  # batch 0 once more
    assert stored(db, "t") == {"a": {"n": 5}}
