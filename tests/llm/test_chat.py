import random

from tallyloom.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string, h1 string, i long"


def brute(rows):
    convs = {}
    for i, (conv, turn, role, text) in enumerate(sorted(set(rows), key=str)):
        convs.setdefault((conv is None, i if conv is None else conv), []).append((turn, role, text))
    key = {c: [x[1:] for x in sorted(t, key=lambda x: (x[0] is not None, x[0] or 0))] for c, t in convs.items()}
    out = []
    for c, k in key.items():
        same = [d for d in key if key[d] == k]
        if c != min(same) or any(len(o) > len(k) and o[: len(k)] == k for o in key.values()):
            continue
        out.append((None if c[0] else c[1], len(k), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in k)))
    return sorted(out, key=str)


def test_same_as_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for conv in range(150):
        n = r.randint(1, 5)
        rows += [(conv, t, ["user", "assistant"][t % 2], r.choice(["hi", "yes", "a\nb"]) if t else "hello") for t in range(n)]
    rows += [(200, 0, None, "x"), (201, 0, "", "x"), (202, 0, None, "x"), (202, 1, "user", None), (None, 0, "user", "hello"), (None, 1, "user", "lone"), (None, 2, "user", "lone"), (None, None, None, None), (203, None, "user", "first"), (203, 0, "user", "second")]
    rows += rows[:7]
    turns = spark.createDataFrame([(*x, "clash", 5) for x in rows], TURNS)
    assert sorted((tuple(x) for x in C.collapse(turns).collect()), key=str) == brute(rows)


def test_long_conversation_and_empty(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2999)] + [(3, 0, "user", "z" * 2_000_000)]
    got = C.collapse(spark.createDataFrame([(*x, "", 0) for x in rows], TURNS)).collect()
    assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(1, 3000), (3, 1)]
    assert C.collapse(spark.createDataFrame([], TURNS)).collect() == []


def test_conversations_over_many_parts(spark):
    """Conversations of all lengths, the longest of which fill whole parts."""
    rows = [(c, t, "user", f"{t % 7}") for c, n in enumerate([2000, 1, 1, 1999, 3, 2500, 1, 700, 2500]) for t in range(n)] + [(50, 0, "user", "x")]
    turns = spark.createDataFrame([(*x, "", 0) for x in rows], TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(x) for x in C.collapse(turns).collect()), key=str)
        hashes = C.prefix_hashes(turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == brute(rows)
    by = {(r["conv"]["conv_id"], r["i"]): (r["p1"], r["p2"]) for r in hashes}
    assert len(by) == len(rows) and len({*by.values()}) == 2501 and all(by[0, i] == by[5, i] for i in range(1, 2001))


def test_no_python_in_the_plan(spark):
    plan = C.collapse(spark.createDataFrame([(1, 0, "u", "t", "", 0)], TURNS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
