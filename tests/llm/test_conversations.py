import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import Row

from gainflow.llm import conversations
from gainflow.llm.queries import op13_conversations


def cheapest(rows):
    """The cheapest edits by a search over all of them, and the rows that they leave; rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]  # cost, audit, row, last initial, rows so far
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c, role in (("u", "user"), ("a", "assistant")):
            if c in follows and not audit.endswith("II"):
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*out, (role, ""))))
            if c in follows and i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 2 + (rows[i][2] == "truncated"), audit + "R", i + 1, c, (*out, (role, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            role, text, fault = rows[i]
            if role[:1] and role[:1] in follows and fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + (fault == "truncated"), audit + "K", i + 1, role[0], (*out, (role, text))))


def brute(rows, harm=True):
    """What the query returns, by plain Python."""
    by = {}
    for r in rows:
        own = by.setdefault(r["conv_id"], [])
        kind = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20 if harm else 9
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r["turn"], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, judged = set(), []
        for _, role, text in own:
            kept = re.sub("[\x20\x09-\x0d]", "", text)
            judged.append((role, text, "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, left = cheapest(judged)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        count = lambda f: sum(x[2] == f for x in judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, k string, block int, EXTRA string"


def stored(spark, rows, folder):
    data = [(*r, "x", 7, None) for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]


def test_query_equals_a_search_over_all_edits(spark, tmp_path):
    pick = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\x0b", None, "Yes.", "ends  ", "what. ", "\U0001f600", "a\nb."]
    rows = [(pick.choice([*range(40), None]), pick.choice([0, 1, 2, 3, 4, 9, None, -3]), pick.choice(roles), pick.choice(texts)) for _ in range(200)]
    rows = [r for i, r in enumerate(rows) if sum(x[0] == r[0] for x in rows[:i]) < 6]
    data = stored(spark, rows, tmp_path)
    assert got(op13_conversations(spark, str(tmp_path))) == brute(data)


def test_empty_table(spark, tmp_path):
    stored(spark, [], tmp_path)
    assert op13_conversations(spark, str(tmp_path)).count() == 0


def test_all_rows_dropped(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    data = stored(spark, [(conv, 0, "user", "Hello.")], tmp_path)
    assert got(op13_conversations(spark, str(tmp_path))) == brute(data) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def fold(rows):
    """Costs and audits by dynamic programming in plain Python, for conversations that a search can't hold."""
    best = {"": (0, "")}

    def inserted(now):
        now = dict(now)
        for _ in range(2):
            for s, (c, a) in list(now.items()):
                t = {"": "u", "s": "u", "a": "u", "u": "a"}[s]
                now[t] = min(now.get(t, (1 << 60, "")), (c + 2, a + "I"))
        return now

    for role, _, fault in rows:
        new = {}
        for s, (c, a) in inserted(best).items():
            steps = [(s, c + 3, a + "D")]
            more = int(fault == "truncated")
            if fault not in ("blank", "duplicate"):
                t = {"": "u", "s": "u", "a": "u", "u": "a"}[s]
                steps += [(t, c + 2 + more, a + "R")] + ([(role[0], c + more, a + "K")] if role[:1] == t or (s, role[:1]) == ("", "s") else [])
            for t, *x in steps:
                new[t] = min(new.get(t, (1 << 60, "")), tuple(x))
        best = new
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def test_a_conversation_of_many_blocks(spark):
    """A conversation that holds most rows, over several blocks, between small ones; copies stand far apart."""
    pick = random.Random(6)
    rows = [(3, t, pick.choice(["user", "assistant", "system", "user", "assistant"]), pick.choice(["One.", "cut", f"Text {t // 3}."])) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in (1, 2, 4, 5) for t in range(4)]
    flagged = conversations.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    solved = conversations.solve(flagged)
    assert solved.filter("conv_id = 3").first()["blocks"][-1]["block"] - solved.filter("conv_id = 3").first()["blocks"][0]["block"] >= 5
    seen, judged, illegal = set(), [], 0
    for c, _, role, text in rows[:3000]:
        judged.append((role, text, "duplicate" if (role, text) in seen else "truncated" if text == "cut" else ""))
        seen.add((role, text))
    r = solved.filter("conv_id = 3").first()
    assert (r["cost"], r["audit"]) == fold(judged)
    assert r["duplicate"] == sum(x[2] == "duplicate" for x in judged)
    assert r["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    out = conversations.repaired(flagged, solved).orderBy("k", "id", "part").collect()
    for c in range(1, 6):
        own = [x["role"][0] for x in out if x["conv_id"] == c]
        assert re.fullmatch("(s?(ua)+)?", "".join(own))
    assert len([x for x in out if x["conv_id"] == 3]) == sum(x != "D" for x in r["audit"])


def test_edits_of_one_conversation(spark):
    rows = [Row(conv_id=1, turn=t, role=r, text=x) for t, r, x in [(0, "system", "Rules."), (1, "user", "Hi."), (2, "user", "Hi."), (3, "user", "And you?"), (4, "assistant", "Well")]]
    flagged = conversations.faults(spark.createDataFrame(rows))
    solved = conversations.solve(flagged)
    r = solved.first()
    assert (r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (1, 1, 2, 6, "KKDIKK")
    out = conversations.repaired(flagged, solved).orderBy("id", "part").collect()
    want = [("system", "Rules.", "keep"), ("user", "Hi.", "keep"), ("assistant", "", "insert"), ("user", "And you?", "keep"), ("assistant", "Well", "keep")]
    assert [(x["role"], x["text"], x["edit"]) for x in out] == want
