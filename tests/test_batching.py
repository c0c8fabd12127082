import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuemill.operators import batching as E
from cuemill.operators.ledger import Ledger


def cues(spark, texts, media="m"):
    return spark.createDataFrame([(media, i + 1, t) for i, t in enumerate(texts)], "media_id string, cue_no int, text string")


def test_inner_line_breaks_are_flattened(spark):
    done, _ = E.translate(cues(spark, ["原文第一行\n原文第二行", "b"]), lambda: E.provider("identity"), "ja", "zh")
    assert [r.translation for r in done.orderBy("cue_no").collect()] == ["原文第一行 原文第二行", "b"]


class Flaky:
    batch_size = 2

    def __init__(self, bad):
        self.bad, self.calls = bad, 0

    def translate_batch(self, texts, source, target):
        self.calls += 1
        if any(t in self.bad for t in texts) and self.calls == 1:
            raise RuntimeError("first call")
        return [t.upper() for t in texts]


class Broken:
    batch_size = 2

    def translate_batch(self, texts, source, target):
        if "bad" in texts:
            raise E.TransientError("again later") if "late" in texts else RuntimeError("no")
        return texts[:-1] if "short" in texts else texts


class Counted:
    """Upper case; notes every request in a file."""

    batch_size = 1

    def __init__(self, path, refuse=(), most=99):
        self.path, self.refuse, self.most = path, refuse, most

    def translate_batch(self, texts, source, target):
        with open(self.path, "a") as f:
            f.write("|".join(texts) + "\n")
        if any(t in self.refuse for t in texts):
            raise E.TransientError("no")
        return [t.upper() for t in texts[: self.most]]


class Single:
    def translate(self, text, source, target):
        return text + "!"


def test_retry(spark):
    done, attempts = E.translate(cues(spark, ["bad", "x"]), lambda: Flaky(["bad"]), "en", "fr", retries=1)
    assert [r.translation for r in done.orderBy("cue_no").collect()] == ["BAD", "X"]
    assert [(r.attempt, r.status) for r in attempts.orderBy("attempt").collect()] == [(0, "failed"), (1, "ok")]


def test_lost_batch_fails_its_item_only(spark):
    both = cues(spark, ["a", "b", "bad", "c"]).union(cues(spark, ["d"], "n")).union(cues(spark, ["short", "x"], "s")).coalesce(1)
    done, attempts = E.translate(both, Broken, "en", "fr", retries=1)
    assert {r.media_id for r in done.collect()} == {"n"}
    assert attempts.where("media_id = 'm' and batch_no = 1").count() == 2


def test_transient_failures_are_not_repeated(spark):
    _, attempts = E.translate(cues(spark, ["bad", "late"]), Broken, "en", "fr", retries=3)
    assert [(r.attempt, r.status) for r in attempts.collect()] == [(0, "transient")]


def test_one_request_per_cue_without_batches(spark):
    done, _ = E.translate(cues(spark, ["a", "b"]), Single, "en", "fr", batch_size=10)
    assert [r.translation for r in done.orderBy("cue_no").collect()] == ["a!", "b!"]


def test_unknown_provider():
    with pytest.raises(ValueError):
        E.provider("nobody")


def test_numbered_replies(spark):
    reply = "Sure:\n1. x\n 2、 y\n2. again\n9. out\n3）\n3) z"
    rows = spark.createDataFrame([("m", 0, 3, reply), ("m", 1, 2, "1. only")], "media_id string, batch_no int, expected long, reply string")
    assert [(r.batch_no, r.pos, r.translation) for r in E.parse_numbered(rows).orderBy("pos").collect()] == [(0, 0, "x"), (0, 1, "y"), (0, 2, "z")]


def test_budget(spark):
    got = E.batch_by_budget(cues(spark, ["x" * 40, "x" * 40, "x" * 200, "x"]), 70).orderBy("cue_no").collect()
    assert [r.batch_no for r in got] == [0, 0, 1, 2]


def test_plan_and_failures(spark):
    media = spark.createDataFrame([("a", 100_000), ("b", 20_000), ("z", 0)], "media_id string, duration_ms long")
    planned = E.plan_chunks(media, F.lit(40)).orderBy("media_id", "chunk_no").collect()
    assert [(r.media_id, r.offset_ms, r.length_ms) for r in planned] == [("a", 0, 40000), ("a", 40000, 40000), ("a", 80000, 20000), ("b", 0, 20000), ("z", 0, 0)]
    results = spark.createDataFrame([("a", 0, None), ("a", 1, "boom")], "media_id string, chunk_no int, error string")
    messages = E.chunk_failures(E.missing_results(E.plan_chunks(media.where("media_id = 'a'"), F.lit(40)), results)).collect()
    assert [r.message for r in messages] == ["2/3 chunk(s) failed transcription: boom"]


def test_halving(spark):
    rows = spark.createDataFrame([("m", 5, i) for i in range(3)] + [("m", 6, 0)], "media_id string, batch_no int, pos int")
    assert [(r.batch_no, r.pos) for r in E.halve_failed_groups(rows).orderBy("batch_no", "pos").collect()] == [(10, 0), (11, 0), (11, 1)]


def test_calls_are_made_once(spark, tmp_path):
    heard = []
    done, attempts = E.translate(cues(spark, ["a", "b", "c"]), lambda: Counted(tmp_path / "calls"), "en", "fr", progress=heard.append)
    for _ in range(2):
        assert done.count() == 3 and attempts.count() == 3 and done.where("translation = 'A'").count() == 1
    assert sorted((tmp_path / "calls").read_text().split()) == ["a", "b", "c"] and heard[-1] == 1.0 and heard == sorted(set(heard))


def test_only_the_first_batch_is_sent_where_it_fails(spark, tmp_path):
    both = cues(spark, ["a", "b", "c"]).union(cues(spark, ["d", "e", "f", "g"], "n")).union(cues(spark, ["h", "no", "i", "j"], "o"))
    done, attempts = E.translate(both, lambda: Counted(tmp_path / "calls", refuse=("a", "no")), "en", "fr", workers=1)
    assert {r.media_id for r in done.collect()} == {"n"}
    assert sorted((tmp_path / "calls").read_text().split()) == ["a", "d", "e", "f", "g", "h", "no"]
    assert {(r.media_id, r.batch_no) for r in attempts.where("status <> 'ok'").collect()} == {("m", 0), ("o", 1)}


def test_requests_are_halved(spark, tmp_path):
    four = cues(spark, ["a", "b", "c", "d"])
    done, attempts = E.translate(four, lambda: Counted(tmp_path / "calls", most=1), "en", "fr", batch_size=4, halve=True)
    assert [r.translation for r in done.orderBy("cue_no").collect()] == ["A", "B", "C", "D"]
    assert (tmp_path / "calls").read_text().split() == ["a|b|c|d", "a|b", "a", "b", "c|d", "c", "d"]
    assert [r.status for r in attempts.collect()] == ["split", "split", "split", "ok"]

    class Slow(Counted):
        def translate_batch(self, texts, source, target):
            if len(texts) > 2:
                raise E.TransientError("timeout")
            return super().translate_batch(texts, source, target)

    done, _ = E.translate(four, lambda: Slow(tmp_path / "more"), "en", "fr", batch_size=4, halve=True)
    assert [r.translation for r in done.orderBy("cue_no").collect()] == ["A", "B", "C", "D"] and (tmp_path / "more").read_text().split() == ["a|b", "c|d"]
    done, attempts = E.translate(cues(spark, list("abcdefgh")), lambda: Slow(tmp_path / "last"), "en", "fr", batch_size=8, halve=True)
    assert done.count() == 0 and [r.status for r in attempts.collect()] == ["split", "transient"]  # a transient failure splits once


def test_chunks_are_heard_once(spark, tmp_path):
    def make():
        def hear(audio, offset, length, options):
            with open(tmp_path / "heard", "a") as f:
                f.write(f"{audio}{offset} ")
            return [(offset, offset + length, "x", 0.0)], "en"

        return hear

    planned = E.plan_chunks(spark.createDataFrame([("a", 90_000)], "media_id string, duration_ms long"), F.lit(30))
    results = E.transcribe(planned, make)
    assert results.count() == 3 and E.missing_results(planned, results).where("error is null").count() == 3 and E.chunk_failures(results).count() == 0
    assert sorted((tmp_path / "heard").read_text().split()) == ["a0", "a30000", "a60000"]


class Slow:
    """Upper case; notes the task and the process of each request, and refuses some."""

    batch_size = 1

    def __init__(self, path, refuse=(), wait_s=0.0):
        self.path, self.refuse, self.wait_s = path, refuse, wait_s

    def translate_batch(self, texts, source, target):
        from pyspark import TaskContext

        with open(self.path, "a") as f:
            f.write(f"{texts[0]} {TaskContext.get().stageId()}-{TaskContext.get().partitionId()}\n")
        time.sleep(self.wait_s)
        if texts[0] in self.refuse:
            raise E.TransientError("no")
        return [t.upper() for t in texts]


def requests(path):
    return [line.split(" ") for line in path.read_text().splitlines()]


def test_calls_are_spread_over_tasks_and_stop(spark, tmp_path):
    many = cues(spark, [f"a{i}" for i in range(40)]).union(cues(spark, [f"b{i}" for i in range(10)], "n"))
    E.translate(many, lambda: Slow(tmp_path / "all", wait_s=0.02), "en", "fr", workers=4)
    calls = requests(tmp_path / "all")
    assert len(calls) == 50 and len({c[0] for c in calls}) == 50
    assert len({task for text, task in calls if text[0] == "a" and text != "a0"}) == 4  # a task for each lane, or more lanes than tasks
    done, attempts = E.translate(many, lambda: Slow(tmp_path / "lost", refuse=("a9",), wait_s=0.3), "en", "fr", workers=4)
    calls = [c[0] for c in requests(tmp_path / "lost")]
    after = [c for c in calls[calls.index("a9") + 1 :] if c[0] == "a"]
    assert len(after) <= 4 and {r.media_id for r in done.collect()} == {"n"}
    assert attempts.where("status = 'transient'").count() == 1


def test_replies_are_kept_for_the_next_run(spark, tmp_path):
    six = cues(spark, [f"a{i}" for i in range(6)])
    kept = f"file://{tmp_path}/ledger"
    done, _ = E.translate(six, lambda: Slow(tmp_path / "one", refuse=("a3",)), "en", "fr", workers=1, ledger=kept)
    assert done.count() == 0 and [c[0] for c in requests(tmp_path / "one")] == ["a0", "a1", "a2", "a3"]
    heard = []
    done, attempts = E.translate(six, lambda: Slow(tmp_path / "two"), "en", "fr", workers=1, ledger=kept, progress=heard.append)
    assert [c[0] for c in requests(tmp_path / "two")] == ["a3", "a4", "a5"]  # a later run tries the lost one again
    assert [r.translation for r in done.orderBy("cue_no").collect()] == [f"A{i}" for i in range(6)] and attempts.count() == 6 and heard[-1] == 1.0
    changed = six.withColumn("text", F.when(F.col("cue_no") == 2, "new").otherwise(F.col("text")))
    E.translate(changed, lambda: Slow(tmp_path / "three"), "en", "fr", workers=1, ledger=kept)
    assert [c[0] for c in requests(tmp_path / "three")] == ["new"]
    E.translate(six, lambda: Slow(tmp_path / "four"), "en", "de", workers=1, ledger=kept)
    assert len(requests(tmp_path / "four")) == 6  # another language is another request


def test_progress_is_heard_while_tasks_run(spark, tmp_path):
    heard = []
    E.translate(cues(spark, [f"a{i}" for i in range(12)]), lambda: Slow(tmp_path / "calls", wait_s=0.3), "en", "fr", workers=2, progress=heard.append)
    assert heard == sorted(set(heard)) and len(heard) >= 5 and heard[-1] == 1.0 and heard[0] <= 2 / 12


KILLED = """
import os, sys, time
os.environ["PYTHONPATH"] = {root!r}
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from cuemill.operators import batching as E

spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()

class Dies:
    batch_size = 1
    def translate_batch(self, texts, source, target):
        with open({calls!r}, "a") as f:
            f.write(texts[0] + "\\n")
        if texts[0] == "a5" and not os.path.exists({mark!r}):
            open({mark!r}, "w").close()
            os.kill(os.getpid(), 9)
        return [t.upper() for t in texts]

cues = spark.createDataFrame([("m", i, f"a{{i}}") for i in range(10)], "media_id string, cue_no int, text string")
done, _ = E.translate(cues, Dies, "en", "fr", workers=1)
assert [r.translation for r in done.orderBy("cue_no").collect()] == [f"A{{i}}" for i in range(10)]
"""


def test_a_killed_task_pays_no_call_twice(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    program = KILLED.format(root=root, calls=str(tmp_path / "calls"), mark=str(tmp_path / "mark"))
    found = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().split()
    assert sorted(calls) == sorted([f"a{i}" for i in range(10)] + ["a5"])  # the one under way when the worker died, and no other


def test_replies_are_packed(spark, tmp_path):
    """Not a file, or a folder, for each request; what is packed is found again, also in the layout of before."""
    many = spark.range(3000).select(F.col("id").cast("string").alias("media_id"), F.lit(1).alias("cue_no"), F.concat(F.lit("t"), "id").alias("text"))
    done, _ = E.translate(many, lambda: Slow(tmp_path / "one"), "en", "fr", ledger=f"file://{tmp_path}/ledger")
    assert done.where("translation = upper(text)").count() == 3000 and len(requests(tmp_path / "one")) == 3000
    assert len(list((tmp_path / "ledger").rglob("*"))) < 2200  # 1,024 buckets
    again, _ = E.translate(many, lambda: Slow(tmp_path / "two"), "en", "fr", ledger=f"file://{tmp_path}/ledger")
    assert again.count() == 3000 and not (tmp_path / "two").exists()
    own = Ledger(f"file://{tmp_path}/old", "run")
    own._put(own._item(own._replies("en>fr"), "7"), own._file(0, ["t7"], "en>fr"), [(0, "ok", None, ["before"])])
    own = Ledger(f"file://{tmp_path}/old", "run")
    assert own.read("7", 0, ["t7"], "en>fr") == [(0, "ok", None, ["before"])] and own.read("7", 0, ["t8"], "en>fr") is None
    for i in range(3):
        own.write("7", i, [f"n{i}"], "en>fr", [(0, "ok", None, [f"N{i}"])])
    assert own.count("en>fr") == 4 and Ledger(f"file://{tmp_path}/old", "run").read("7", 1, ["n1"], "en>fr") == [(0, "ok", None, ["N1"])]  # before they are packed
    own.flush()
    assert own.count("en>fr") == 4 and Ledger(f"file://{tmp_path}/old", "run").read("7", 1, ["n1"], "en>fr") == [(0, "ok", None, ["N1"])]
