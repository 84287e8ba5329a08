import hashlib
import random
import re
import zlib

from leadloom.llm import chat_repair
from leadloom.llm.common import table
from leadloom.llm.queries import QUERIES

COLUMNS = "conv_id bigint, turn bigint, role string, text string, cost string, piece int, audit string, conv string"


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _plain_repair(rows):
    """Every state's cheapest, then least, edits, row by row."""
    seen, faults = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(found):
        for _ in range(3):
            for q, (cost, audit, kept) in list(found.items()):
                role = "a" if q == "u" else "u"
                new = (cost + 5, audit + "I", [*kept, ({"u": "user", "a": "assistant"}[role], "")])
                if role not in found or new[:2] < found[role][:2]:
                    found[role] = new
        return found

    now = with_inserts({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        to = {}
        for q, (cost, audit, kept) in now.items():
            choices = [(q, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                choices += [(role[:1], more, "K", [(role, text)])] if role[:1] and role[0] in after[q] else []
                choices += [(r[0], 1 + more, "R", [(r, text)]) for r in ("user", "assistant") if r[0] in after[q]]
            for state, price, letter, rest in choices:
                new = (cost + price, audit + letter, kept + rest)
                if state not in to or new[:2] < to[state][:2]:
                    to[state] = new
        now = with_inserts(to)
    cost, audit, kept = min((now[q] for q in ("", "a") if q in now), key=lambda x: x[:2])
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    pairs = zip(rows, rows[1:])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _plain(rows):
    after = _plain_damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps if gaps < 1 << 63 else None, *_plain_repair([r[1:] for r in own]))
    return out


def _got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(rows) == len(found)
    return found


def test_query_against_plain_version(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, folder, "conversations").collect()]
        assert _got(QUERIES["op12_converging_repair"](spark, folder)) == _plain(rows)


def _random_rows(rng):
    rows = []
    for conv in [None, *range(40)]:
        roles = rng.choice([["user", "assistant"], ["user"], ["assistant"], ["system", "user", "assistant", "tool", "", None]])
        for turn in range(rng.choice([1, 3, 9, 60, 300])):
            text = rng.choice(["Yes.", "no", "", None, " \t", f"Word {rng.randrange(10**6)}!", f"Word {rng.randrange(10**6)}", "A? ", "x" * 80 + str(rng.random()) + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice(roles), text))
    rows += [(77, t, "user", f"All mine {t}.") for t in range(900)]
    rows += [(78, t, "user", "The same.") for t in range(700)]
    rows += [(79, None, "user", "Alike.")] * 400 + [(80, -(1 << 63), "user", "A."), (80, (1 << 63) - 1, "assistant", "B.")]
    rng.shuffle(rows)
    return rows


def test_pieces_agree_with_the_whole(spark):
    rows = _random_rows(random.Random(8))
    expected = _plain(rows)
    df = spark.createDataFrame([(*r, "9", 3, "K", "=1") for r in rows], COLUMNS).repartition(3)
    assert _got(chat_repair.report(df, piece=7, stitched=3)) == expected
    assert _got(chat_repair.report(df)) == expected
    assert chat_repair.report(df.where("false")).count() == 0


def test_fix_up_is_exact_for_every_vector():
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choice(range(16)) for _ in range(rng.randint(0, 40)))
        before, between = chat_repair.fixed_up(codes)
        for vector, costs in enumerate(chat_repair.VECTORS):
            for code in reversed(codes):
                costs = chat_repair._before(code, costs)
            least = min(costs)
            assert between[vector] == least and chat_repair.VECTORS[before[vector]] == tuple(c - least for c in costs)


def test_texts_of_repaired_conversations(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello."), ("user", "And?")])]
    wholes, parts = chat_repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = [r for df in (wholes, parts) for r in df.collect()]
    roles = [x["role"][0] for r in sorted(found, key=lambda r: r["piece"]) for x in r["repaired"]]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))
