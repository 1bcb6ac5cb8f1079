import random

import pytest
from pyspark.sql import functions as F

from verdigraph.streaming.sessions import sessions

SCHEMA = "user string, seq long, action string, session string, text string"


def brute(events):
    """The sessions left, by replaying the events user by user."""
    state = {}
    for user, _, action, session, text in sorted((e for e in events if e[0] is not None), key=lambda e: e[1]):
        own = state.setdefault(user, {"all": {f"{user}-1": ["Nova Conversa", 0]}, "active": f"{user}-1", "last": 1})
        if action == "new":
            own["last"] += 1
            own["active"] = f"{user}-{own['last']}"
            own["all"][own["active"]] = ["Nova Conversa", 0]
        elif action == "switch" and session in own["all"]:
            own["active"] = session
        elif action == "delete" and session in own["all"] and len(own["all"]) > 1:
            del own["all"][session]
            if own["active"] == session:
                own["active"] = next(iter(own["all"]))
        elif action == "ask":
            one = own["all"][own["active"]]
            if one[0] == "Nova Conversa":
                t = (text or "").strip()
                one[0] = (t if len(t) <= 26 else t[:26].strip() + "...") or "Nova Conversa"
            one[1] += 1
    return sorted((u, s, t, n, "active" if s == own["active"] else "open") for u, own in state.items() for s, (t, n) in own["all"].items())


def play(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        user = rng.choice(["ana", "bo-1", "c", None])
        action = rng.choice(["new", "switch", "delete", "ask", "ask", "what", None])
        out.append((user, i, action, f"{rng.choice([user, 'ana'])}-{rng.randrange(1, 6)}" if rng.random() < 0.9 else None, rng.choice(["oi", "uma pergunta bem mais longa que o título", "", None])))
    return out


def rows(df):
    return sorted((r.user, r.session, r.title, r.n_questions, r.status) for r in df.collect() if r.status != "deleted")


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_brute_force(spark, seed):
    events = play(seed, 200)
    assert rows(sessions(spark.createDataFrame(events, SCHEMA).repartition(3))) == brute(events)


def test_stream_equals_replay(spark, tmp_path):
    events = play(3, 120)
    (tmp_path / "in").mkdir()
    with_store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in with_store}
    for k, v in with_store.items():
        spark.conf.set(k, v)
    try:
        for at in (0, 50, 90):
            spark.createDataFrame(events[at : {0: 50, 50: 90, 90: 120}[at]], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            found = sessions(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))

            def put(batch, number):
                batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

            found.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("user", "session").agg(F.max_by(F.struct("title", "n_questions", "status"), "batch").alias("x")).select("user", "session", "x.*")
    assert rows(last) == brute(events)


def test_no_events(spark):
    assert sessions(spark.createDataFrame([], SCHEMA)).collect() == []
