import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest

from harrow.llm import repair

from .conftest import CLASHING


def plain_cheapest(initials, faults):
    """The least (cost, audit) by going through all edits from each place, in order."""
    n = len(initials)

    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == n and state in "^a" else []
        if i < n:
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if faults[i] not in (1, 2):
                more = int(faults[i] == 3)
                if state + initials[i] in ("^s", "^u", "su", "au", "ua"):
                    cost, audit = best(i + 1, initials[i], 0)
                    options.append((cost + more, "K" + audit))
                cost, audit = best(i + 1, "a" if state == "u" else "u", 0)
                options.append((cost + 2 + more, "R" + audit))
        if inserts < 3:
            cost, audit = best(i, "a" if state == "u" else "u", inserts + 1)
            options.append((cost + 2, "I" + audit))
        return min(options) if options else (10**6, "")

    return best(0, "^", 0)


@pytest.mark.parametrize("seed", range(6))
def test_audit_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.randrange(0, 9)
        initials = "".join(rng.choice("uuaasx") for _ in range(n))
        faults = bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert repair.cheapest_audit(initials.replace("x", "\0").encode(), faults) == plain_cheapest(initials, faults), (initials, faults)


def test_long_conversations():
    n = 30_000
    cost, audit = repair.cheapest_audit(b"ua" * (n // 2), bytes(n))
    assert (cost, audit) == (0, "K" * n)
    initials = bytes(random.Random(1).choice(b"ua") for _ in range(n))
    cost, audit = repair.cheapest_audit(initials, bytes(n))
    assert len(audit) - audit.count("I") == n and cost == 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I"))


def plain_repair(rows):
    """Damage and repair of (conv, turn, role, text) rows as the rules say, in plain Python."""
    out = []
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, own in groupby(sorted(rows, key=key), key=key):
        kept, name = [], None
        for c, turn, role, text in own:
            name = c
            pick = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
            kept += [] if pick == 0 else [(turn, "user" if pick == 4 else role, text)] * (1 + (pick == 3))
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = {t for t, *_ in kept if t is not None}
        initials = "".join((r[:1] if r[:1] in tuple("sua") else "x") for _, r, _ in kept)
        cost, audit = plain_cheapest(initials, tuple(faults))
        done, at, state = [], 0, "^"
        for letter in audit:
            fit = "assistant" if state == "u" else "user"
            if letter == "I":
                done.append((fit, ""))
            else:
                if letter != "D":
                    done.append((kept[at][1] if letter == "K" else fit, kept[at][2]))
                at += 1
            state = done[-1][0][0] if letter != "D" else state
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append(((name, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest), [(name, i, *d) for i, d in enumerate(done, 1)]))
    return sorted((o[0] for o in out), key=repr), sorted((r for o in out for r in o[1]), key=repr)


def talk_rows():
    rng = random.Random(11)
    texts = ["Yes.", "Yes.", "no", "What?  ", "", None, " \t", "A longer one! ", "É.\n", "x.y", "a" * 5000 + "."]
    rows = []
    for c in [None, *range(150)]:
        for t in range(rng.randrange(1, 9)):
            turn = rng.choice([t, t, t, t, t + 3, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows + rows[:5]


NAMES = "conv_id long, turn long, role string, text string"


def test_repair_equals_plain_rules(spark):
    rows = talk_rows()
    df = spark.createDataFrame(rows, NAMES)
    for i, c in enumerate((*CLASHING, "conv", "place", "print", "mark", "fault", "lost", "audit", "gaps")):
        df = df.withColumn(c, df["turn"] * 0 + i)
    damaged = repair.damaged(df)
    numbers, talks = plain_repair(rows)
    assert sorted((tuple(r) for r in repair.repair_conversations(damaged, lost="lost").collect()), key=repr) == numbers
    assert sorted((tuple(r) for r in repair.repaired_rows(damaged, lost="lost").collect()), key=repr) == talks


def test_no_rows(spark):
    none = spark.createDataFrame([], NAMES)
    assert repair.repair_conversations(repair.damaged(none), lost="lost").collect() == []
    assert repair.repaired_rows(none).collect() == []
