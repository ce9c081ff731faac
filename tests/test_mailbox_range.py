"""A mailbox server in files: ranges, pushed days, lost connections, and a stream that goes on."""

from __future__ import annotations

import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.sources import mailbox_range as M


def server(folder: str, fail_first: int = 0):
    """A function that connects to the mails in ``folder/<name>.json``; the first calls to fetch in each process fail."""

    def connect():
        class Client:
            def _log(self, what):
                with open(os.path.join(folder, "log"), "a") as f:
                    f.write(json.dumps(what) + "\n")

            def _mails(self, name):
                with open(os.path.join(folder, name + ".json")) as f:
                    return {int(k): v for k, v in json.load(f).items()}

            def folders(self):
                return sorted(f[:-5] for f in os.listdir(folder) if f.endswith(".json"))

            def bounds(self, name):
                path = os.path.join(folder, name + ".json")
                uids = list(self._mails(name)) if os.path.exists(path) else []
                return (min(uids), max(uids)) if uids else None

            def search(self, name, since, before, low, high):
                self._log(["search", name, str(since), str(before), low, high])
                day = lambda m: datetime.fromisoformat(m).date()
                return [u for u, m in self._mails(name).items() if low <= u <= high and (since is None or day(m) >= since) and (before is None or day(m) < before)]

            def fetch(self, name, uids):
                marks = [f for f in os.listdir(folder) if f.startswith("failed")]
                if len(marks) < fail_first:
                    open(os.path.join(folder, f"failed{len(marks)}"), "w").close()
                    raise ConnectionResetError("lost")
                self._log(["fetch", name, len(uids)])
                return [(u, ["\\Seen"], datetime.fromisoformat(self._mails(name)[u]), f"mail {u}".encode()) for u in uids]

            def close(self):
                pass

        return Client()

    return connect


def put(folder, name, first, n, day=date(2024, 1, 1)):
    path = folder / f"{name}.json"
    held = json.loads(path.read_text()) if path.exists() else {}
    held |= {str(u): datetime.combine(day + timedelta(days=u % 10), datetime.min.time()).isoformat() for u in range(first, first + n)}
    path.write_text(json.dumps(held))


def asked(folder, what):
    return [x for x in map(json.loads, (folder / "log").read_text().splitlines()) if x[0] == what]


def test_ranges_and_days(spark, tmp_path):
    put(tmp_path, "INBOX", 5, 100)
    put(tmp_path, "Sent", 1, 10)
    put(tmp_path, "Junk", 1, 10)
    put(tmp_path, "Empty", 1, 0)
    mails = M.read_mails(spark, server(str(tmp_path)), date(2024, 1, 2), date(2024, 1, 3), partition="30", batch="4")
    got = sorted((r["folder"], r["uid"]) for r in mails.collect())
    assert got == sorted([("INBOX", u) for u in range(5, 105) if u % 10 in (1, 2)] + [("Sent", 1), ("Sent", 2)])
    assert {tuple(x[1:4]) for x in asked(tmp_path, "search")} == {("INBOX", "2024-01-02", "2024-01-04"), ("Sent", "2024-01-02", "2024-01-04")}
    assert len({tuple(x) for x in asked(tmp_path, "search")}) == 5 and max(x[2] for x in asked(tmp_path, "fetch")) <= 4
    row = mails.where("uid = 1").first()
    assert (row["flags"], row["day"], bytes(row["raw"])) == (["\\Seen"], date(2024, 1, 2), b"mail 1")


def test_folders_and_other_filters(spark, tmp_path):
    for name in ("A", "B", "C", "Trash"):
        put(tmp_path, name, 1, 20)
    all_ = M.read_mails(spark, server(str(tmp_path)))
    assert all_.count() == 60
    (tmp_path / "log").unlink()
    assert all_.where("folder in ('B', 'Trash') and day > date'2024-01-08' and length(raw) > 6").count() == 2
    assert {x[1] for x in asked(tmp_path, "search")} == {"B"} and {x[2] for x in asked(tmp_path, "search")} == {"2024-01-09"}
    assert all_.where("folder = 'nowhere'").count() == 0 and all_.where("folder = 'A' and folder = 'B'").count() == 0
    assert M.read_mails(spark, server(str(tmp_path)), folders="C").select("folder").distinct().collect()[0][0] == "C"


def test_lost_connections(spark, tmp_path):
    put(tmp_path, "INBOX", 1, 10)
    assert M.read_mails(spark, server(str(tmp_path), 3), backoff="0").count() == 10
    for f in tmp_path.glob("failed*"):
        f.unlink()
    with pytest.raises(Exception, match="4 attempts failed: lost"):
        M.read_mails(spark, server(str(tmp_path), 400), backoff="0").count()


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    put(box, "INBOX", 1, 7)

    def run():
        stream = M.stream_mails(spark, server(str(box)), partition="3").select("folder", "uid")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())

    first = [("INBOX", u) for u in range(1, 8)]
    assert run() == first
    put(box, "INBOX", 8, 2)
    put(box, "Later", 40, 2)
    assert run() == [*first, ("INBOX", 8), ("INBOX", 9), ("Later", 40), ("Later", 41)]
    assert run() == [*first, ("INBOX", 8), ("INBOX", 9), ("Later", 40), ("Later", 41)]
