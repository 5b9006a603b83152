"""Chat formatting against a plain event loop."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from oracle_harness import compare, duck
from shopfloor.llm import chat, queries

LOG = "conv_id long, seq long, message long, kind string, role string, text string"
TABLE = "conv_id long, turn long, role string, text string"


def plain_fold(events):
    """Final messages (message, role, text) of each conversation, one event after the other."""
    logs = collections.defaultdict(list)
    for c, seq, m, kind, role, text in events:
        if seq is not None and m is not None and kind in chat.KINDS:
            logs[c].append((seq, kind, role is not None, role or "", text or "", m))
    out = {}
    for c, log in logs.items():
        first, text, roles, regenerated = {}, {}, {}, collections.defaultdict(lambda: -1)
        for seq, kind, given, role, t, m in sorted(log):
            first.setdefault(m, seq)
            if given:
                roles.setdefault(m, role)
            text[m] = text.get(m, "") + t if kind == "delta" else t
            if kind == "regenerate":
                regenerated[m] = seq
        order = sorted(first, key=lambda m: (first[m], m))
        out[c] = [(m, roles.get(m, ""), text[m]) for k, m in enumerate(order)
                  if not any(regenerated[x] > first[m] for x in order[:k])]
    return out


def folded(log):
    got = collections.defaultdict(list)
    for r in chat.fold(log).orderBy("start", "message").collect():
        got[r.conv_id].append((r.message, r.role, r.text))
    return dict(got)


def test_fold_of_a_log(spark):
    events = [
        (1, 10, 1, "start", "user", "helo"), (1, 11, 2, "start", "assistant", None), (1, 12, 2, "delta", None, "Hi "),
        (1, 13, 2, "delta", None, "you"), (1, 14, 1, "edit", None, "hello"), (1, 15, 3, "start", "user", "thanks"),
        (1, 16, 2, "regenerate", None, None), (1, 17, 2, "delta", None, "Hello."), (1, 18, 4, "start", "user", "bye"),
        (1, 18, 4, "delta", None, "!"), (2, 5, 1, "delta", "assistant", "no start"), (None, 1, 1, "start", "user", "x")]
    want = {1: [(1, "user", "hello"), (2, "assistant", "Hello."), (4, "user", "bye")], 2: [(1, "assistant", "no start")], None: [(1, "user", "x")]}
    assert plain_fold(events) == want
    assert folded(spark.createDataFrame(events, LOG)) == want


def test_random_logs(spark):
    rng = random.Random(13)
    kinds = [*chat.KINDS, "delta", "delta", None, "like"]
    events = [(rng.choice([1, 2, 3, 4, 4, 4, 4, 4, None]), rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3, 4, 5, 6]),
               rng.choice(kinds), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b<", "\\l", "</turn>\n"]))
              for _ in range(600)]
    # an event's place among others of its number and kind: null roles first, as Spark sorts
    df = spark.createDataFrame(events, LOG).repartition(6)
    assert folded(df) == plain_fold(events)
    left = [e for e in events if e[1] is None or e[2] is None or e[3] not in chat.KINDS]
    out = chat.rejects(df)
    assert out.count() == len(left) and {r.reason for r in out.select("reason").distinct().collect()} == {
        "no sequence number", "no message", "unknown kind"}


TEXTS = [None, "", "a", "\\", "<", "\\l\\b<", "</turn>\n<turn>user<text>", chat.TRAP, "é日🙂" * 900, "line\nline", "ends \\"]


def conversations():
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, "a<b>\\"]), rng.choice(TEXTS))
            for c in [None, 1, 2, 3, 4] for _ in range(8)]
    rows += [rows[0], rows[9], rows[9], (50, None, None, None)] + [(77, k % 40, "assistant" if k % 2 else "user", TEXTS[k % 11]) for k in range(700)]
    return rows


def expected(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in [*rows, (-7, 0, "user", chat.TRAP), (-7, 1, "assistant", chat.TRAP)]:
        convs[c].append((turn is None, turn or 0, role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        esc = lambda t: t.replace("\\", "\\b").replace("<", "\\l")
        formatted = "".join(f"<turn>{esc(r)}<text>{esc(t)}</turn>\n" for *_, r, t in turns)
        out.append((c, len(turns), sha(said), len(learned), sha(learned), len(formatted)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_registered_query(spark, tmp_path, extra):
    rows = conversations()
    df = spark.createDataFrame(rows, TABLE).repartition(4)
    if extra:
        df = df.select("*", *[F.lit(1).alias(n) for n in ("seq", "message", "kind", "start", "loss", "formatted", "parts", "wide", "turns")])
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in queries.op13_event_chat(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(rows)


def test_registered_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], TABLE).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in queries.op13_event_chat(spark, str(tmp_path)).collect()] == expected([])


def test_the_mask_and_the_turns_of_an_output(spark):
    rows = conversations()
    out = chat.render(chat.fold(chat.log_of(spark.createDataFrame(rows, TABLE), delta_chars=3)))
    for r in out.collect():
        at = [(s.start, s.start + s.length) for s in r.loss]
        assert all(a <= b <= c for (_, b), (c, _), a in zip(at, at[1:], [s for s, _ in at]))
        assert all(r.formatted[a - len(chat.TEXT):a] == chat.TEXT and r.formatted[b:b + len(chat.END)] == chat.END for a, b in at)
        turns = r.formatted.split(chat.END)
        assert turns.pop() == "" and sum(t.startswith(chat.TURN + "assistant" + chat.TEXT) for t in turns) == len(at)


def test_one_exchange_of_the_texts(spark, tmp_path):
    spark.createDataFrame(conversations(), TABLE).write.parquet(str(tmp_path / "conversations.parquet"))
    plan = queries.op13_event_chat(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan and "Arrow" not in plan


def test_oracle(spark):
    small = "/root/testdata/sf0.001"
    problems, *_ = compare(spark, duck(small), "op13_event_chat", queries.op13_event_chat, chat.ORACLE_SQL, small)
    assert not problems, problems
