"""All rules of a command in their order, against a machine that takes the commands one by one."""

import random

from pyspark.sql import functions as F

from ledgerfold.operators import apply

CMD = "idx long, client string, seq long, digest string, op string, malformed boolean"
TOUCHED = "idx long, pos int, key string, role string, expected string, value string"


def machine(cmds, touched, state, locks, owned, moving, applied, sessions):
    now, base, sessions, out = dict(state), dict(state), dict(sessions), {}
    for idx, client, seq, digest, op, malformed in sorted(cmds):
        items = sorted((p, k, r, e, v) for i, p, k, r, e, v in touched if i == idx)
        if idx <= applied:
            out[idx] = ("OK", True, None, None)
            continue
        if malformed:
            out[idx] = ("INVALID", False, None, None)
            continue
        if client and client in sessions:
            last, known, answer = sessions[client]
            if seq == last:
                out[idx] = (answer[0], True, *answer[2:]) if known == digest else ("INVALID", False, None, None)
                continue
            if seq < last:
                out[idx] = ("INVALID", False, None, None)
                continue
        keys = [k for _, k, *_ in items]
        code, observed, failed = "OK", None, None
        if any(not owned(k) for k in keys):
            code = "WRONG_SHARD"
        elif any(moving(k, op) for k in keys):
            code = "MOVING"
        elif any(k in locks for k in keys):
            code = "LOCKED"
        elif op == "batch":
            bad = [p for p, k, r, e, _ in items if r == "check" and base.get(k) != e]
            code = "INVALID" if not items else "MISMATCH" if bad else "OK"
            failed = bad[0] if bad else None
        else:
            _, k, r, e, v = items[0]
            if r == "cas" and now.get(k) != e:
                code, observed = "MISMATCH", now.get(k)
            else:
                now[k] = None if r == "delete" else v
        out[idx] = (code, False, observed, failed)
        if client:
            sessions[client] = (seq, digest, out[idx])
    return out


def test_rules_in_their_order(spark):
    rng = random.Random(9)
    keys = [f"k{i}" for i in range(8)]
    state = {k: rng.choice("abc") for k in keys[:5]}
    cmds, touched = [], []
    for i in range(1, 500):
        op = rng.choice(("put", "delete", "cas", "cas", "batch"))
        cmds.append((i, rng.choice((None, "", "c1", "c2", "c3")), i // 6 - rng.randrange(3), rng.choice("xy"), op, rng.random() < 0.05))
        if op == "batch":
            for p in range(rng.randrange(4)):
                check = rng.random() < 0.5
                touched.append((i, p, rng.choice(keys), "check" if check else "put", rng.choice((None, "a", "b")) if check else None, None if check else "z"))
        else:
            touched.append((i, 0, rng.choice(keys), op, rng.choice((None, "a", "b", "c")) if op == "cas" else None, None if op == "delete" else rng.choice("abc")))
    sessions = {"c1": (12, "x", ("MISMATCH", False, None, None)), "c9": (3, "x", ("OK", False, None, None))}
    locks = {"k1"}
    want = machine(cmds, touched, state, locks, lambda k: k != "k7", lambda k, op: k in ("k6", "k7") and op != "delete", 10, sessions)
    got = apply.decide(
        spark.createDataFrame(cmds, CMD), spark.createDataFrame(touched, TOUCHED), spark.createDataFrame(list(state.items()), "key string, value string"),
        spark.createDataFrame([(k,) for k in locks], "key string"), F.col("key") != "k7", F.col("key").isin("k6", "k7") & (F.col("op") != "delete"), 10,
        spark.createDataFrame([(c, n, d, a[0]) for c, (n, d, a) in sessions.items()], "client string, last_seq long, digest string, code string"),
    )
    found = {r["idx"]: (r["code"], r["deduplicated"], r["observed"], r["failed_check"]) for r in got.collect()}
    assert found == want
    assert {c for c, *_ in want.values()} == {"OK", "INVALID", "WRONG_SHARD", "MOVING", "LOCKED", "MISMATCH"}
