import random

from gridwright.llm import preference, queries


def rendered(turns):
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def spans(turns):
    out, at = [], 0
    for role, text in turns:
        start = at + len(role) + 5
        if role == "assistant":
            out.append((start, start + len(text) + 7))
        at = start + len(text) + 8
    return out


def brute(good, bad):
    common = 0
    while common < min(len(good), len(bad)) and good[common] == bad[common]:
        common += 1
    return rendered(good[:common]), common, rendered(good[common:]), spans(good[common:]), rendered(bad[common:]), spans(bad[common:])


def frame(spark, talks):
    rows = [(p, n, role, text, "x") for p, talk in talks.items() for n, (role, text) in enumerate(talk)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, good string")


def collected(found):
    return {r["pair"]: (r["prompt"], r["prompt_turns"], r["chosen"], [tuple(s) for s in r["chosen_mask"]], r["rejected"],
                        [tuple(s) for s in r["rejected_mask"]]) for r in found.collect()}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    good, bad = {}, {}
    for p in range(60):
        talk = [(rng.choice(["user", "assistant", "system"]), rng.choice(["", "yes", "é \U0001f600\n", "no no"])) for _ in range(rng.randint(1, 7))]
        other = list(talk[: rng.randint(0, len(talk))]) + [("assistant", str(n)) for n in range(rng.randint(0, 3))]
        good[p] = talk
        if other:
            bad[p] = other
    got = collected(preference.format_pairs(frame(spark, good), frame(spark, bad), "conv_id"))
    assert got == {p: brute(good[p], bad.get(p, [])) for p in good}
    for prompt, _, chosen, mask, _, _ in got.values():
        assert all(chosen[b - 7: b] == "<|end|>" for _, b in mask)


def test_one_side_only_long_turns_and_nulls(spark):
    good = frame(spark, {1: [("user", "q"), ("assistant", "a" * 300_000)], 2: [("user", "x")]})
    bad = frame(spark, {1: [("user", "q"), ("assistant", "b")], 3: [("assistant", "z")]})
    got = collected(preference.format_pairs(good, bad, "conv_id"))
    assert got[1][1] == 1 and len(got[1][2]) == 300_000 + len("<|assistant|>\n<|end|>\n")
    assert got[2] == brute([("user", "x")], []) and got[3] == brute([], [("assistant", "z")])
    odd = spark.createDataFrame([(None, 1, "user", "a"), (None, None, None, None), (4, 1, None, "b"), (4, 1, None, "b")],
                                "conv_id long, turn long, role string, text string")
    got = collected(preference.format_pairs(odd, odd, "conv_id"))
    assert got[None] == brute([("", ""), ("user", "a")], [("", ""), ("user", "a")])
    assert got[4][1] == 2 and got[4][2] == got[4][4] == ""
    assert preference.format_pairs(odd.limit(0), odd.limit(0), "conv_id").count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = queries.QUERIES["op1_preference"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    rows = queries.QUERIES["op1_preference"](spark, sf).collect()
    assert {r["conv_id"] for r in rows} == set(talks)
    for r in rows:
        talk = talks[r["conv_id"]]
        assert r["prompt"] + r["chosen"] == rendered(talk)
        replies = [n for n, (role, _) in enumerate(talk) if role == "assistant"]
        worse = list(talk)
        if replies:
            first, last = talk[replies[0]][1], talk[replies[-1]][1]
            worse[replies[-1]] = ("assistant", first if first != last else last[: len(last) // 2])
        assert r["prompt"] + r["rejected"] == rendered(worse)
        assert r["prompt_turns"] == (replies[-1] if replies else len(talk))
